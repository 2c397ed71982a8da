"""SentencePiece encoding that keeps, for every piece, the bytes of the original text it came from.

The text is normalised by the model's compiled character map, longest prefix first, and every normalised byte
remembers the original bytes behind it. The installed sentencepiece library turns normalised stretches into
pieces; piece lengths are then laid over the alignment, so each piece points to a byte span of the given text.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from sentencepiece import SentencePieceProcessor

from airzone.llm.common import only, sliced

SPACE = "▁"


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of every field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, message[at:at + size]
        at += size


class CharacterMap:
    """A compiled map: a double-array trie of source prefixes over UTF-8 bytes, then their replacements, each ended by a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled[4:4 + size], "<u4").tolist()
        self.replacements = compiled[4 + size:]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of ``text[at:]``, and its replacement."""
        if not self.units:
            return None
        offset = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
        found, node = None, offset(self.units[0])
        for i in range(at, len(text)):
            node ^= text[i]
            unit = self.units[node]
            if unit & ((1 << 31) | 255) != text[i]:
                break
            node ^= offset(unit)
            if unit >> 8 & 1:
                start = self.units[node] & 0x7FFFFFFF
                found = i + 1 - at, self.replacements[start:self.replacements.index(b"\0", start)]
        return found


class Encoder:
    """One model's pieces with byte spans."""

    def __init__(self, model: bytes):
        self.processor = SentencePieceProcessor(model_proto=model)
        spec = dict(_fields(next((v for k, v in _fields(model) if k == 3), b"")))
        self.map = CharacterMap(spec.get(2, b""))
        self.prefixed, self.trimmed, self.marked = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.vocab_size())]
        #: normalised bytes of every piece; -1 for the unknown piece
        self.sizes = np.array([1 if self.processor.is_byte(i) else 0 if self.processor.is_control(i) else
                               -1 if self.processor.is_unknown(i) else len(p.encode()) for i, p in enumerate(pieces)])
        #: original bytes of every piece in a text without a character map; 0 for a byte of a longer character
        inside = [self.processor.is_byte(i) and int(p[3:5], 16) > 127 for i, p in enumerate(pieces)]
        self.lengths = np.array([0 if s < 0 or b else s - 2 * p.count(SPACE) for s, b, p in zip(self.sizes, inside, pieces)])
        self.irregular = np.array(inside) | (self.sizes < 0)

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text with begin and end, as the library gives them."""
        found = self.processor.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        return [np.frombuffer(array("I", ids), "<u4") for ids in found]

    def normalised(self, text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Normalised bytes, and for each the first and last original byte behind it (end exclusive).

        At every place the longest prefix in the character map is replaced; elsewhere one character is kept.
        Without a map only spaces are replaced, and the alignment is computed for all bytes at once.
        """
        data, mark = text.encode(), SPACE.encode() if self.marked else b" "
        if self.map.units or self.trimmed:
            parts, starts, ends = self._mapped(data, mark)
            flat = b"".join(parts)
            sizes = np.fromiter(map(len, parts), np.int64, len(parts))
            starts, ends = np.repeat(np.array(starts, np.int32), sizes), np.repeat(np.array(ends, np.int32), sizes)
        else:
            flat = data.replace(b" ", mark)
            raw = np.frombuffer(data, np.uint8)
            first = np.flatnonzero((raw & 0xC0) != 0x80).astype(np.int32)
            sizes = np.diff(first, append=np.int32(len(raw)))
            wide = np.where(raw[first] == 32, len(mark), sizes)
            starts, ends = np.repeat(first, wide), np.repeat(first + sizes, wide)
        if flat and self.prefixed:
            edge = np.zeros(len(mark), np.int32)
            flat, starts, ends = mark + flat, np.concatenate([edge, starts]), np.concatenate([edge, ends])
        return flat, starts, ends

    def _mapped(self, data: bytes, mark: bytes) -> tuple[list[bytes], list[int], list[int]]:
        parts, starts, ends, at = [], [], [], 0
        while at < len(data):
            lead = data[at]
            size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            size, piece = self.map.longest(data, at) or (size, data[at:at + size])
            for byte in (piece[i:i + 1] for i in range(len(piece))):
                parts.append(mark if byte == b" " else byte)
                starts.append(at)
                ends.append(at + size)
            at += size
        if self.trimmed:        # leading and trailing spaces and all but one of a run
            keep = [i for i, p in enumerate(parts) if p != mark or (i and parts[i - 1] != mark)]
            while keep and parts[keep[-1]] == mark:
                keep.pop()
            parts, starts, ends = ([x[i] for i in keep] for x in (parts, starts, ends))
        return parts, starts, ends

    def spans(self, text: str, ids: np.ndarray) -> np.ndarray:
        """Original byte span (start, end) of every id; begin and end have empty spans at the text's ends."""
        if not self.map.units and not self.trimmed and self.prefixed and self.marked and SPACE not in text and not self.irregular[ids].any():
            ends = np.cumsum(self.lengths[ids])     # one ahead, for the space put before the text
            return np.maximum(np.stack([ends - self.lengths[ids], ends], axis=1) - 1, 0).astype(np.int32)
        flat, starts, ends = self.normalised(text)
        sizes = self.sizes[ids]
        if (unknown := sizes < 0).any():        # a stretch that the vocabulary lacks, as long as the library says
            surface = [p for p in self.processor.encode(text, out_type=str)]
            sizes[1:-1][unknown[1:-1]] = [len(p.encode()) for p, u in zip(surface, unknown[1:-1]) if u]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        whole = len(text.encode())
        starts, ends = np.append(starts, whole), np.append(ends, whole)
        low = starts[np.minimum(bounds[:-1], len(flat))]
        return np.stack([low, np.where(sizes > 0, ends[np.clip(bounds[1:] - 1, 0, len(flat))], low)], axis=1).astype(np.int32)


@cache
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


ENCODED = "n_tokens long, ids binary, spans binary, decoded string"
#: Characters of text whose results are held at a time.
HELD = 500_000


def encoded(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, spans, decoded) of every row, over its whole text.

    ``ids`` packs the ids, with begin and end, as little-endian unsigned 32-bit integers; ``spans`` packs for each id
    the start and the end of its bytes in the UTF-8 text as signed ones; ``decoded`` is what the library decodes from
    the ids. Null and empty text has the ids of begin and end. Rows are encoded where they lie, without a shuffle;
    repeated rows give repeated rows, an empty table none.

    The driver reads the model file once and broadcasts its bytes: one model, whose size does not grow with the data.
    """
    docs = only(docs, doc_id=id_col, text=text_col)
    with open(model_path, "rb") as file:
        model = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _encoder(model.value)
        for batch in batches:
            for part, texts in sliced(batch, "text", HELD):
                ids = one.ids(texts)
                spans = [one.spans(text, i).astype("<i4").tobytes() for text, i in zip(texts, ids)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()),
                     pa.array(spans, pa.binary()), pa.array(one.processor.decode([i.tolist() for i in ids]), pa.string())],
                    names=["doc_id", "n_tokens", "ids", "spans", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {ENCODED}")
