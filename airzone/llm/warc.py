"""Web archives and a two-level capture index over them.

Pages become WARC records, one gzip member each. The index sorts reversed-host URL keys into compressed blocks and keeps a
sparse directory with the first key of every block: a lookup searches the parts, then the directory of a
part, reads one block by its byte range and searches it, and reads the record by its range. Files go to shared storage
through ``pyarrow.fs``; their names carry the task attempt, and only those of finished attempts get into the index.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, urlsplit
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import only, picked
from airzone.sources.tables import new_path, stage


@dataclass(frozen=True)
class Layout:
    """Archives roll over at ``roll`` bytes; a block holds ``block_lines`` captures; payloads under ``min_bytes`` are never revisits."""

    roll: int = 128_000_000
    block_lines: int = 1000
    part_lines: int = 1_000_000
    min_bytes: int = 0
    level: int = 4


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    files, path = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    files.create_dir(path, recursive=True)
    return files, path


def _name(kind: str, ending: str) -> str:
    task = TaskContext.get()
    return f"{kind}-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid4().hex[:8]}.{ending}"


def url_key(url: str | None) -> str:
    """The URL with its host reversed, so that a domain's captures sort together: ``com,example,www)/path?query``.

    What cannot be parsed is its own key. Blanks are escaped.
    """
    url = url or ""
    try:
        parts = urlsplit(url)
        host, port = parts.hostname, parts.port
    except ValueError:
        host = None
    if not host:
        return quote(url, safe="/:?#[]@!$&'()*+,;=%")
    reverse = ",".join(reversed(host.rstrip(".").split(".")))
    at = f":{port}" if port and port not in (80, 443) else ""
    query = f"?{parts.query}" if parts.query else ""
    return quote(f"{reverse}{at}){parts.path or '/'}{query}", safe="/:?#[]@!$&'()*+,;=%")


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{url_key(url)} {'' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record with its payload, or a revisit record without."""
    kind = "response" if refers_to is None else "revisit"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='/:?#[]@!$&()*+,;=%')}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = payload if refers_to is None else b""
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Payload-Length: {len(payload)}", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; a response must match its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    if lines[0] != "WARC/1.1" or (fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != f"sha1:{digest32(body)}"):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, body


def _member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str, layout: Layout) -> DataFrame:
    """(key, file, offset, length) of the record written for every row of ``pages`` (page_id, url, html); stored before use.

    Of rows with equal payloads the largest page_id is the response. Only digests and ids are shuffled to find it, so a
    payload of a third of all rows is a sum, not a group; rows that repeat that id are responses too. Payloads stay where they
    are while the list of repeated digests is short enough to be sent to them (``common.picked``).
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("sum", F.sha1("payload"))
    repeated = (rows.where(F.length("payload") >= layout.min_bytes).groupBy("sum").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
                .where("n > 1 AND response IS NOT NULL").select("sum", "response"))
    marked = picked(rows, stage(repeated, "repeated-payloads"), "sum", "left").select(
        "page_id", "url", "payload", F.when(~F.col("response").eqNullSafe(F.col("page_id")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        out, name = None, ""
        for batch in batches:
            found = []
            for page_id, url, body, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None or out.tell() >= layout.roll:
                    if out is not None:
                        out.close()
                    name = _name("pages", "warc.gz")
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                data, at = _member(record(page_id, url, body, refers_to), layout.level), out.tell()
                out.write(data)
                found.append((capture_key(url, page_id), name, at, len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()))],
                                             names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stage(marked.mapInArrow(run, "key string, file string, offset long, length long"), "captures")


def write_index(captures: DataFrame, folder: str, layout: Layout) -> list[tuple[str, str]]:
    """Sorted blocks and their directories, one pair of files per part; gives the first key and file name of every part.

    The list is as long as the index has parts, a number that ``layout.part_lines`` keeps to one in a million captures.
    """
    parts = max(1, -(-captures.count() // layout.part_lines), min(16, captures.sparkSession.sparkContext.defaultParallelism))
    ordered = captures.repartitionByRange(parts, "key", "file", "offset").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        name, lines, directory, at, out = "", [], [], 0, None

        def flush() -> None:
            nonlocal lines, at
            block = zlib.compress("\n".join(lines).encode(), layout.level)
            out.write(block)
            directory.append(f"{lines[0].rsplit(' ', 3)[0]}\t{at}\t{len(block)}")
            at, lines = at + len(block), []

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if out is None:
                    name = _name("part", "cdx")
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                lines.append(" ".join(map(str, row)))
                if len(lines) >= layout.block_lines:
                    flush()
        if lines:
            flush()
        if out is not None:
            out.close()
            with files.open_output_stream(f"{path}/{name}.idx", compression=None) as idx:
                idx.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([name])], names=["first", "name"])

    made = stage(ordered.mapInArrow(run, "first string, name string"), "index-parts")
    return sorted((r["first"], r["name"]) for r in made.collect())


class Index:
    """One task's view of the index: files, directories and the last block are kept open."""

    def __init__(self, folder: str, parts: list[tuple[str, str]]):
        self.files, self.path = _open(folder)
        self.parts, self.firsts = parts, [first for first, _ in parts]
        self.directories: dict[str, list[tuple[str, int, int]]] = {}
        self.blocks: dict[tuple[str, int], list[tuple[str, str]]] = {}
        self.handles: dict[str, object] = {}

    def read(self, name: str, at: int, length: int) -> bytes:
        if name not in self.handles:
            if len(self.handles) > 64:
                self.handles.popitem()[1].close()
            self.handles[name] = self.files.open_input_file(f"{self.path}/{name}")
        return self.handles[name].read_at(length, at)

    def directory(self, name: str) -> list[tuple[str, int, int]]:
        if name not in self.directories:
            self.directories = {}
            with self.files.open_input_stream(f"{self.path}/{name}.idx", compression=None) as idx:
                lines = idx.read().decode().split("\n")
            self.directories[name] = [(k, int(a), int(n)) for k, a, n in (line.split("\t") for line in lines)]
        return self.directories[name]

    def block(self, name: str, at: int, length: int) -> list[tuple[str, str]]:
        if (name, at) not in self.blocks:
            if len(self.blocks) > 8:
                self.blocks = {}
            lines = zlib.decompress(self.read(name, at, length)).decode().split("\n")
            self.blocks[name, at] = [(line.rsplit(" ", 3)[0], line) for line in lines]
        return self.blocks[name, at]

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """File, offset and length of every capture of ``key``; equal keys may run on over blocks and parts."""
        before = lambda firsts: max(bisect_right(firsts, key) - 1, 0)
        start = before(self.firsts)
        while start > 0 and self.firsts[start] == key:
            start -= 1
        for part in range(start, len(self.parts)):
            if self.firsts[part] > key:
                return
            name = self.parts[part][1]
            rows = self.directory(name)
            at = before([k for k, _, _ in rows])
            while at > 0 and rows[at][0] == key:
                at -= 1
            for first, offset, length in rows[at:]:
                if first > key:
                    return
                for found, line in self.block(name, offset, length):
                    if found == key:
                        file, position, size = line.rsplit(" ", 3)[1:]
                        yield file, int(position), int(size)


def look_up(requests: DataFrame, folder: str, parts: list[tuple[str, str]]) -> DataFrame:
    """The record of every capture of the requested (url, page_id), read through the index.

    Requests are range-partitioned by key, so a task reads neighbouring blocks once each.
    """
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(u, p) for u, p in zip(batch.column("url").to_pylist(), batch.column("page_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string())], names=["key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, parts)
        number = lambda text: int(text[10:-1]) if text and text[10:-1] else None
        for batch in batches:
            out = []
            for key in batch.column("key").to_pylist():
                for file, at, length in index.find(key):
                    fields, body = parsed(zlib.decompress(index.read(file, at, length), 31))
                    out.append((number(fields["WARC-Record-ID"]), int(fields["WARC-Payload-Length"]), fields["WARC-Payload-Digest"][5:],
                                fields["WARC-Type"], number(fields.get("WARC-Refers-To")), key, file, at, length))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 9, kinds)], names=FOUND_NAMES)

    keys = requests.select("url", "page_id").mapInArrow(keyed, "key string").distinct()
    # a fixed number of tasks: keys are small, so adaptive coalescing would leave all the reading to one
    tasks = max(len(parts), 2 * requests.sparkSession.sparkContext.defaultParallelism)
    return keys.repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, FOUND)


FOUND = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
         "url_key string, file string, offset long, length long")
FOUND_NAMES = [part.split()[0] for part in FOUND.split(", ")]


def archived(pages: DataFrame, layout: Layout = Layout()) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as archives with an index, and reads every record back through it.

    Gives page_id, payload_bytes, payload_digest, record_type and refers_to of every row, and where its record lies.
    Null html is an empty payload; a null url has an empty key; a null page_id is smaller than all others. Repeated rows
    have records of their own. An empty table gives no row.
    """
    pages = only(pages, page_id=pages["page_id"].cast("long"), url="url", html="html")
    folder = new_path(pages.sparkSession, "archive")
    captures = write_archives(pages, folder, layout)
    parts = write_index(captures, folder, layout)
    return look_up(pages, folder, parts)
