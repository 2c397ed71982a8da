"""Byte-level BPE: whole pre-tokens by a minimal perfect hash, all others by merges from a heap over linked bytes.

A rank file names every token's bytes and rank. Pre-tokens are the matches of a pattern. Those that are tokens
themselves are found in the first tier, a hash without collisions whose slots are exactly the tokens; the rest
start as single bytes in a linked list, and a heap gives the adjacent pair of the lowest rank until none is a token.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import only, sliced

STEP = np.uint64(0x9E3779B97F4A7C15)


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


@dataclass
class PerfectHash:
    """Keys without gaps: ``slots[place]`` is the number of the one key that can be found at ``place``.

    A key's bucket gives either its place itself or a seed under which all keys of the bucket have places of
    their own. Crowded buckets choose their seeds first, buckets of one key take the places that are left.
    """

    seed: int
    buckets: np.ndarray
    slots: np.ndarray

    @staticmethod
    def of(keys: list[bytes]) -> PerfectHash:
        seed = 0
        while len(np.unique(hashes := _hashes(keys, seed))) < len(keys):
            seed += 1
        n = max(len(keys), 1)
        buckets, slots, free = np.zeros(n // 4 + 1, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        home = (hashes % np.uint64(len(buckets))).astype(np.int64)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(len(buckets) + 1))
        sizes = np.diff(starts)
        for bucket in np.argsort(-sizes, kind="stable"):
            members = order[starts[bucket]:starts[bucket + 1]]
            if len(members) < 2:
                break
            first = 1
            while True:
                seeds = np.arange(first, first + 64, dtype=np.uint64)
                places = np.sort(_places(hashes[members][None, :], seeds[:, None], n), axis=1)
                fits = free[places].all(1) & (np.diff(places, axis=1) > 0).all(1)
                if fits.any():
                    break
                first += 64
            buckets[bucket] = first + fits.argmax()
            places = _places(hashes[members], seeds[fits.argmax()][None], n)
            slots[places], free[places] = members, False
        single = np.flatnonzero(sizes == 1)
        left = np.flatnonzero(free)[:len(single)]
        slots[left], buckets[single] = order[starts[single]], -1 - left
        return PerfectHash(seed, buckets, slots)

    def candidates(self, keys: list[bytes]) -> np.ndarray:
        """For every key the number of the only known key that it can equal."""
        hashes = _hashes(keys, self.seed)
        held = self.buckets[(hashes % np.uint64(len(self.buckets))).astype(np.int64)]
        return self.slots[np.where(held < 0, -1 - held, _places(hashes, held.astype(np.uint64), len(self.slots)))]


def _hashes(keys: list[bytes], seed: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k, seed) for k in keys), np.uint64, len(keys))


def _places(hashes: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    return (_scrambled(hashes + seeds * STEP) % np.uint64(n)).astype(np.int64)


@dataclass
class Vocabulary:
    """Tokens by id, which is their rank, and the hash that finds them."""

    tokens: list[bytes]
    known: PerfectHash
    pattern: str

    @staticmethod
    @cache
    def read(path: str, pattern: str) -> Vocabulary:
        """The rank file at ``path``: lines of a token in base 64 and its rank, ranks from 0 without gaps."""
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        tokens = sorted(ranks, key=ranks.__getitem__)
        if [ranks[t] for t in tokens] != list(range(len(tokens))) or not {bytes([b]) for b in range(256)} <= set(tokens):
            raise ValueError(f"{path}: ranks must run from 0 without gaps and hold every single byte")
        return Vocabulary(tokens, PerfectHash.of(tokens), pattern)


#: Characters of text whose pre-tokens are held at a time.
HELD = 1_000_000


class Coder:
    """Ids of texts. A worker remembers the ids of up to ``most`` pre-tokens and starts anew beyond them."""

    def __init__(self, vocabulary: Vocabulary, most: int = 300_000):
        self.tokens, self.known, self.most = vocabulary.tokens, vocabulary.known, most
        self.matches = regex.compile(vocabulary.pattern)
        self.rank = {token: i for i, token in enumerate(self.tokens)}
        self.single = [self.rank[bytes([b])] for b in range(256)]
        self.double = [self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]
        self.seen: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._packed(part) for part in self._parts(text)), "<u4")

    def decoded(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def _parts(self, text: str) -> Iterator[list[str]]:
        if len(text) <= HELD:
            yield self.matches.findall(text)
            return
        found = (m.group() for m in self.matches.finditer(text))
        while part := list(islice(found, HELD // 8)):
            yield part

    def _packed(self, pretokens: list[str]) -> bytes:
        self.learn(pretokens)
        return b"".join(map(self.seen.__getitem__, pretokens))

    def learn(self, pretokens: Iterable[str]) -> None:
        wanted = set(pretokens)
        new = [t for t in wanted if t not in self.seen]
        if len(self.seen) + len(new) > self.most:
            self.seen, new = {}, list(wanted)
        raw = [t.encode() for t in new]
        for text, data, i in zip(new, raw, self.known.candidates(raw).tolist()):
            self.seen[text] = array("I", (i,) if self.tokens[i] == data else self.merged(data)).tobytes()

    def merged(self, data: bytes) -> list[int]:
        """Ids after all merges: the lowest rank first, of equal ranks the leftmost.

        ``after[i]`` is the end of the part that starts at byte i, and so the start of the next one. ``joint[i]`` is the
        rank of that part with the next one, -1 where they do not merge or where an earlier part has taken byte i in;
        entries of the heap that name another rank are out of date.
        """
        size, rank = len(data), self.rank.get
        part = [self.single[b] for b in data]
        after, before = list(range(1, size + 1)), list(range(-1, size))
        joint = [self.double[a << 8 | b] for a, b in zip(data, data[1:])] + [-1]
        shift = size.bit_length()
        low = (1 << shift) - 1
        heap = [r << shift | i for i, r in enumerate(joint) if r >= 0]
        heapify(heap)
        while heap:
            entry = heappop(heap)
            i = entry & low
            if joint[i] != entry >> shift:
                continue
            part[i] = joint[i]
            j = after[i]
            end = after[i] = after[j]
            joint[j], before[end] = -1, i
            joint[i] = r = rank(data[i:after[end]], -1) if end < size else -1
            if r >= 0:
                heappush(heap, r << shift | i)
            if (k := before[i]) >= 0:
                joint[k] = r = rank(data[k:end], -1)
                if r >= 0:
                    heappush(heap, r << shift | k)
        out, at = [], 0
        while at < size:
            out.append(part[at])
            at = after[at]
        return out


_coders: dict[str, Coder] = {}


def _coder(name: str, vocabulary: Vocabulary) -> Coder:
    """The worker's coder, kept for later tasks; another vocabulary takes its place."""
    if name not in _coders:
        _coders.clear()
        _coders[name] = Coder(vocabulary)
    return _coders[name]


ENCODED = "n_tokens long, ids array<int>, decoded binary"


def encoded(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row, over its whole text, without special tokens.

    ``decoded`` is what the ids give back, which is the text in UTF-8. Null and empty text has no ids and decodes to
    nothing. Rows are encoded where they lie, without a shuffle; repeated rows give repeated rows, an empty table none.
    Other columns of ``docs`` are not read.

    The driver reads the rank file once and broadcasts the vocabulary, whose size does not grow with the data.
    """
    docs = only(docs, doc_id=id_col, text=text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.read(ranks_path, pattern))
    name = f"{ranks_path} {pattern}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _coder(name, shared.value)
        for batch in batches:
            for part, texts in sliced(batch, "text", HELD):
                ids = [one.ids(text) for text in texts]
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), lists, pa.array([one.decoded(i) for i in ids], pa.binary())],
                    names=["doc_id", "n_tokens", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, {ENCODED}")


def digested(found: DataFrame) -> DataFrame:
    """Ids and decoded bytes of ``encoded`` as digests."""
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
