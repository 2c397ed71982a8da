"""Alignment of two tokenizers by the bytes of their tokens, and how often the corpus links two tokens.

Both encodings of a text cover the same bytes. Offsets at which tokens of both end cut them into groups; within a
group every token of A is linked with every token of B. The offsets are merged in lockstep: one state vector holds
the pointers of all documents of a chunk, every step moves the pointer whose token ends first (both at a cut, which
is emitted), and finished documents leave the vector.

How many documents link two ids is a matter of the whole corpus. A chunk keeps its links as numbers into its own
sorted list of distinct pairs; only those lists are shuffled, to be counted and to bring the counts back.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from sentencepiece import SentencePieceProcessor

from airzone.llm.common import only, sliced
from airzone.sources.tables import stage

#: Tokens of A after which a long document goes on in another lane of the state vector, at the next cut.
LANE = 1024
#: Links of a group above which its ids are counted before they are paired.
WIDE = 4096


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


def cuts(a_ends: np.ndarray, b_ends: np.ndarray, a_from: np.ndarray, b_from: np.ndarray, a_to: np.ndarray) -> np.ndarray:
    """Groups of all lanes as rows (a_from, a_to, b_from, b_to) of token numbers, in order.

    Lane k holds the tokens from ``a_from[k]`` to ``a_to[k]`` of A and from ``b_from[k]`` on of B; both end at one offset.
    """
    state = np.array([a_from, b_from, a_from, b_from, a_to])[:, a_to > a_from]
    out = []
    while state.shape[1]:
        i, j, since_i, since_j, last = state
        x, y = a_ends[i], b_ends[j]
        cut = np.flatnonzero(x == y)
        i += x <= y
        j += y <= x
        if len(cut):
            out.append(np.array([since_i[cut], i[cut], since_j[cut], j[cut]]))
            since_i[cut], since_j[cut] = i[cut], j[cut]
            going = i < last
            if not going.all():
                state = state[:, going]
    found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
    return found[:, found[0].argsort()]


def lanes(a_ends: np.ndarray, b_ends: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers at which lanes begin, and the ends: document borders, and cuts near every ``LANE`` tokens of a long one."""
    a, b = np.cumsum([0, *a_counts]), np.cumsum([0, *b_counts])
    inner = np.concatenate([np.arange(s + LANE, e, LANE) for s, e in zip(a[:-1], a[1:])] or [np.empty(0, int)]).astype(int)
    if len(inner):
        near = np.minimum(inner[:, None] + np.arange(64), len(a_ends) - 1)
        place = np.minimum(np.searchsorted(b_ends, a_ends[near]), len(b_ends) - 1)
        same = b_ends[place] == a_ends[near]
        row, first = np.flatnonzero(same.any(1)), same.argmax(1)
        a, keep = np.unique(np.concatenate([a, near[row, first[row]] + 1]), return_index=True)
        b = np.concatenate([b, place[row, first[row]] + 1])[keep]
    return a, b


class Aligner:
    """Two vocabularies: byte-level BPE from its JSON file as A, a sentencepiece model as B."""

    def __init__(self, a_file: bytes, b_file: bytes, pattern: str):
        letters, given = byte_letters(), json.loads(a_file)
        special = {t["content"] for t in given["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in given["model"]["vocab"].items() if t not in special}
        # ids of the vocabulary are the ranks of its merges, so the rank-based library gives its ids
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = SentencePieceProcessor(model_proto=b_file)
        self.a_bytes = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.a_bytes[i] = token
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.vocab_size())))]
        self.a_sizes, self.b_sizes = (np.fromiter(map(len, t), np.int64, len(t)) for t in (self.a_bytes, self.b_bytes))
        self.base = len(self.b_bytes)
        #: every id with the sign that may follow it
        self.spelled = [f"{i}{sign}" for i in range(max(len(self.a_bytes), self.base)) for sign in ",|;"]

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of A and B; none where the text is empty or the bytes of either differ from the text behind a space."""
        if not text:
            return [], []
        given = " " + text
        a, b, whole = self.a.encode_ordinary(given), self.b.encode(text), given.encode()
        same = b"".join(map(self.a_bytes.__getitem__, a)) == whole == b"".join(map(self.b_bytes.__getitem__, b))
        return (a, b) if same else ([], [])

    def aligned(self, texts: list[str]) -> Aligned:
        a, b, a_counts, b_counts = array("I"), array("I"), [], []
        for text in texts:
            own = self.tokens(text)
            a.extend(own[0])
            b.extend(own[1])
            a_counts.append(len(own[0]))
            b_counts.append(len(own[1]))
        return Aligned(self, np.frombuffer(a, "<u4").astype(np.int64), np.frombuffer(b, "<u4").astype(np.int64), np.array(a_counts, int), np.array(b_counts, int))


class Aligned:
    """Groups of the documents of a chunk, as ranges of the tokens of all of them."""

    def __init__(self, by: Aligner, a: np.ndarray, b: np.ndarray, a_counts: np.ndarray, b_counts: np.ndarray):
        self.by, self.a, self.b, self.a_counts, self.b_counts = by, a, b, a_counts, b_counts
        # a document's bytes are as many in A as in B, so offsets can run on from one document to the next
        a_ends, b_ends = np.cumsum(by.a_sizes[a]), np.cumsum(by.b_sizes[b])
        a_lanes, b_lanes = lanes(a_ends, b_ends, a_counts, b_counts)
        self.a_from, self.a_to, self.b_from, self.b_to = cuts(a_ends, b_ends, a_lanes[:-1], b_lanes[:-1], a_lanes[1:])
        self.doc = np.searchsorted(np.cumsum(a_counts), self.a_from, "right")
        self.links = (self.a_to - self.a_from) * (self.b_to - self.b_from)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum per document of a value per group."""
        ends = np.cumsum([0, *np.bincount(self.doc, minlength=len(self.a_counts))])
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[ends[1:]] - sums[ends[:-1]]

    def digests(self) -> list[str]:
        """SHA-256 of every document's groups spelled out, ids of A and of B in order; empty without tokens."""
        signs = np.empty(len(self.a) + len(self.b), np.int64)
        groups = np.arange(len(self.a_from))
        a_sign, b_sign = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        a_sign[self.a_to - 1], b_sign[self.b_to - 1] = 1, 2
        signs[np.arange(len(self.a)) + self.b_from[np.repeat(groups, self.a_to - self.a_from)]] = self.a * 3 + a_sign
        signs[np.arange(len(self.b)) + self.a_to[np.repeat(groups, self.b_to - self.b_from)]] = self.b * 3 + b_sign
        ends = np.cumsum([0, *(self.a_counts + self.b_counts)])
        return [hashlib.sha256("".join(map(self.by.spelled.__getitem__, signs[s:e].tolist()))[:-1].encode()).hexdigest() if e > s else ""
                for s, e in zip(ends[:-1], ends[1:])]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, pair, links) of every distinct pair of a document, in order; a pair is A's id times B's size plus B's id.

        A wide group pairs each of its ids once, however often they repeat in it, and multiplies their counts.
        """
        by, span = self.by.base, self.by.base * len(self.by.a_bytes)
        narrow = np.flatnonzero(self.links <= WIDE)
        keys = []
        steps = np.searchsorted(np.cumsum(self.links[narrow]), np.arange(1, self.links[narrow].sum() // 500_000 + 1) * 500_000)
        for some in np.split(narrow, steps):
            n, width = self.links[some], self.b_to[some] - self.b_from[some]
            group = np.repeat(np.arange(len(some)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = self.a[self.a_from[some][group] + k // width[group]], self.b[self.b_from[some][group] + k % width[group]]
            keys.append(self.doc[some][group] * span + a * by + b)
        found, times = np.unique(np.concatenate(keys), return_counts=True)
        for g in np.flatnonzero(self.links > WIDE):
            (a, m), (b, n) = (np.unique(x, return_counts=True) for x in (self.a[self.a_from[g]:self.a_to[g]], self.b[self.b_from[g]:self.b_to[g]]))
            found, back = np.unique(np.concatenate([found, (self.doc[g] * span + a[:, None] * by + b).ravel()]), return_inverse=True)
            sums = np.zeros(len(found), np.int64)
            np.add.at(sums, back, np.concatenate([times, np.outer(m, n).ravel()]))
            times = sums
        return found // span, found % span, times


@cache
def _aligner(a_file: bytes, b_file: bytes, pattern: str) -> Aligner:
    return Aligner(a_file, b_file, pattern)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers, the bytes of equal weight together and compressed."""
    return zstandard.compress(np.ascontiguousarray(values.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


#: Characters of text of a chunk.
HELD = 4_000_000


class _Shared:
    """The two files, broadcast once; their size does not grow with the data."""

    def __init__(self, docs: DataFrame, a_path: str, b_path: str, pattern: str):
        read = []
        for path in (a_path, b_path):
            with open(path, "rb") as file:
                read.append(file.read())
        self.files, self.pattern = docs.sparkSession.sparkContext.broadcast(tuple(read)), pattern

    def aligner(self) -> Aligner:
        return _aligner(*self.files.value, self.pattern)


def aligned(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, a, b, a_cuts, b_cuts) of every row: the ids of both tokenizers, and behind how many of them each group ends.

    Null and empty texts, and those whose bytes a tokenizer changes, have no tokens. Rows are aligned where they lie.
    """
    docs = only(docs, doc_id=id_col, text=text_col)
    shared = _Shared(docs, a_path, b_path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in sliced(batch, "text", HELD // 4):
                one = shared.aligner().aligned(texts)
                n = one.total(np.ones(len(one.doc), int))
                offsets = [np.cumsum([0, *c]) for c in (one.a_counts, one.b_counts, n)]
                values = [one.a, one.b, one.a_to - offsets[0][one.doc], one.b_to - offsets[1][one.doc]]
                lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v, pa.int32())) for o, v in zip([*offsets, offsets[2]], values)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], names=["doc_id", "a", "b", "a_cuts", "b_cuts"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, a array<int>, b array<int>, a_cuts array<int>, b_cuts array<int>")


PER_DOC = ("n_a", "n_b", "n_groups", "n_links")


def _chunks(docs: DataFrame, shared: _Shared) -> DataFrame:
    """One row per chunk: its documents, their links as numbers into ``pairs``, and in how many of them each pair occurs."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, texts in sliced(batch, "text", HELD):
                one = shared.aligner().aligned(texts)
                doc, pair, times = one.pairs()
                pairs, which = np.unique(pair, return_inverse=True)
                counts = one.a_counts, one.b_counts, one.total(np.ones(len(one.doc), int)), one.total(one.links)
                row = {"chunk": [number], "doc_id": [part.column("doc_id")], **{n: [c] for n, c in zip(PER_DOC, counts)}, "groups_sha256": [one.digests()],
                       "n_pairs": [np.bincount(doc, minlength=len(texts))], "which": [_packed(np.diff(which, prepend=0))], "times": [_packed(times)],
                       "pairs": [_packed(np.diff(pairs, prepend=0))], "holders": [_packed(np.bincount(which, minlength=len(pairs)))]}
                lists = {"doc_id": pa.list_(part.column("doc_id").type), "groups_sha256": pa.list_(pa.string()), "chunk": pa.int64()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, lists.get(n, pa.binary() if isinstance(v[0], bytes) else pa.list_(pa.int64()))) for n, v in row.items()], names=list(row))
                number += 1

    numbers = ", ".join(f"{n} array<long>" for n in PER_DOC)
    return docs.mapInArrow(run, f"chunk long, doc_id array<{kind}>, {numbers}, groups_sha256 array<string>, n_pairs array<long>, "
                                "which binary, times binary, pairs binary, holders binary")


def _listed(chunks: DataFrame) -> DataFrame:
    """(chunk, place, pair, holders) of every distinct pair of a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, pairs, holders in zip(*(batch.column(c).to_pylist() for c in ("chunk", "pairs", "holders"))):
                pair = np.cumsum(_unpacked(pairs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), chunk), pa.int64()), pa.array(np.arange(len(pair)), pa.int32()), pa.array(pair, pa.int64()),
                     pa.array(_unpacked(holders), pa.int64())], names=["chunk", "place", "pair", "holders"])

    return chunks.select("chunk", "pairs", "holders").mapInArrow(run, "chunk long, place int, pair long, holders long")


def alignment(docs: DataFrame, a_path: str, b_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    The count of two ids is the number of rows of ``docs`` that link them. ``count_sum`` adds it up over a row's links,
    ``n_best`` are the links whose count is the highest of their id of A. Null and empty texts, and those whose bytes a
    tokenizer changes, have zeros and an empty digest. Repeated rows count each, an empty table gives none; other
    columns of ``docs`` are not read.

    A row is tokenized once. Its links stay in its chunk of about ``HELD`` characters; the shuffles carry the distinct
    pairs of every chunk, and at the end each chunk to the counts of its pairs.
    """
    docs = only(docs, doc_id=id_col, text=text_col)
    shared = _Shared(docs, a_path, b_path, pattern)
    base = SentencePieceProcessor(model_file=b_path).vocab_size()
    chunks = stage(_chunks(docs, shared), "alignment-chunks")
    listed = _listed(chunks)
    # an id of A has at most as many pairs as B has ids, which bounds the window
    best = F.max("count").over(Window.partitionBy(F.expr(f"pair div {base}")))
    totals = stage(listed.groupBy("pair").agg(F.sum("holders").alias("count")).withColumn("best", F.col("count") == best), "pair-counts")
    known = listed.select("chunk", "place", "pair").join(totals, "pair").select("chunk", "place", "count", "best")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def close(documents: pa.Table, counted: pa.Table) -> pa.Table:
        place = counted.column("place").to_numpy()
        count, top = np.zeros(len(place), np.int64), np.zeros(len(place), bool)
        count[place], top[place] = counted.column("count").to_numpy(), counted.column("best").to_numpy()
        out = []
        for row in range(len(documents)):
            one = {c: documents.column(c)[row] for c in documents.column_names}
            which, times = np.cumsum(_unpacked(one["which"].as_py())), _unpacked(one["times"].as_py())
            ends = np.cumsum([0, *one["n_pairs"].values.to_numpy()])
            sums = [np.concatenate([[0], np.cumsum(v)]) for v in (times * top[which], times * count[which])]
            out.append(pa.table([one["doc_id"].values, *(one[n].values for n in PER_DOC), *(s[ends[1:]] - s[ends[:-1]] for s in sums), one["groups_sha256"].values],
                                names=["doc_id", *PER_DOC, "n_best", "count_sum", "groups_sha256"]))
        return pa.concat_tables(out)

    whole = chunks.drop("pairs", "holders")
    numbers = ", ".join(f"{n} long" for n in (*PER_DOC, "n_best", "count_sum"))
    return whole.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(close, f"doc_id {kind}, {numbers}, groups_sha256 string")
