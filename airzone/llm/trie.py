"""Prefix trie of conversations, as balanced parentheses per shard of the sorted conversations.

Every conversation is a path of turn digests. Sorted by path, conversations that share a beginning lie next to each
other, and a run of them, a shard, is a small trie: an opening parenthesis where a node is first met, a closing one
behind its last descendant. Blocks of excess with their smallest values find the closing parenthesis that ends a
subtree; ranks of leaf pairs and running sums of savings between the two give the subtree's totals.

Only nodes on a shard's first and last path can be shared with other shards. They are the shard's spine and become two
weighted paths of the next level, which is a trie over shards in the same way; everything else is final. Levels go on
until one shard holds all paths that are left.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import only
from airzone.sources.tables import stage

#: Characters of a turn's digest in a path.
WIDTH = 32
#: Parentheses of a block of excess.
BLOCK = 64
#: Nodes on the paths of a shard of conversations.
SHARD = 20_000
#: Nodes on the paths of a shard of spines, and paths that it may always hold.
SPINES, FEW = 200_000, 64
EMPTY = hashlib.sha256(b"").hexdigest()


def rebuilt(turns: DataFrame, group: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, path, sizes): every conversation behind the first turns of the first one of its ``group``.

    ``turns`` has conv_id, turn, role and text. Turns are ordered by turn, null first, equal ones by the digest of their
    role and text; null role and text is empty. A conversation c takes the first ``crc32(c) % most`` turns of
    c - c % group and goes on with its own turns behind that many. ``path`` joins the turns' digests, ``sizes`` holds the
    code points of their texts. Rows without conv_id belong to no conversation; no row gives none.

    Texts are digested where they lie. A conversation's turns meet as (turn, digest, size) in one row, its path.
    """
    said = only(turns, conv=turns["conv_id"].cast("long"), turn="turn", role=F.coalesce(turns["role"], F.lit("")), text=F.coalesce(turns["text"], F.lit("")))
    digest = F.left(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"), 256), F.lit(WIDTH))
    own = (said.where("conv IS NOT NULL").select("conv", F.struct("turn", digest.alias("digest"), F.length("text").cast("long").alias("size")).alias("t"))
           .groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
           .select("conv", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["size"].alias("size"))).alias("turns")))
    own = stage(own, "conversations")
    first = F.col("conv") - F.col("conv") % group
    heads = own.where(F.col("conv") == first).select(F.col("conv").alias("head"), F.slice("turns", 1, most).alias("head_turns"))
    taken = (F.crc32(F.col("conv").cast("string").cast("binary")) % most).cast("int")
    both = own.join(heads, first == F.col("head"), "left").select("conv", F.concat(
        F.coalesce(F.slice("head_turns", F.lit(1), taken), F.slice("turns", 1, 0)), F.slice("turns", taken + 1, F.greatest(F.size("turns"), F.lit(0)))).alias("turns"))
    return both.select(F.col("conv").alias("conv_id"), F.array_join(F.transform("turns", lambda t: t["digest"]), "").alias("path"),
                       F.transform("turns", lambda t: t["size"]).alias("sizes"))


class Parentheses:
    """A balanced sequence, True for opening, with the smallest excess of every block of ``BLOCK`` and of ranges of blocks."""

    def __init__(self, opening: np.ndarray):
        n = len(opening)
        self.excess = np.cumsum(np.where(opening, 1, -1)).astype(np.int32)
        blocks = 1 << max(-(-n // BLOCK) - 1, 0).bit_length()
        # behind the end the excess is out of reach of every search
        self.blocks = np.pad(self.excess, (0, blocks * BLOCK - n), constant_values=np.iinfo(np.int32).max).reshape(blocks, BLOCK)
        self.least = [self.blocks.min(1)]
        while len(self.least[-1]) > 1:
            self.least.append(self.least[-1].reshape(-1, 2).min(1))
        #: leaf pairs, an opening parenthesis followed by its closing one, up to and including each place
        self.pairs = np.cumsum(opening & ~np.append(opening[1:], True))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """Places of the parentheses that close those at ``at``: the next place with one less excess."""
        out = np.empty(len(at), np.int64)
        for k in range(0, len(at), 65536):
            out[k:k + 65536] = self._findclose(at[k:k + 65536])
        return out

    def _findclose(self, at: np.ndarray) -> np.ndarray:
        wanted = self.excess[at] - 1
        block, inside = at // BLOCK, at % BLOCK
        here = (self.blocks[block] <= wanted[:, None]) & (np.arange(BLOCK)[None, :] > inside[:, None])
        out = block * BLOCK + here.argmax(1)
        far = np.flatnonzero(~here.any(1))
        if not len(far):
            return out
        # up to the first range to the right that comes down to the wanted excess, then down to its first block
        node, level, aim = block[far], np.zeros(len(far), np.int64), wanted[far]
        going = np.ones(len(far), bool)
        for h, least in enumerate(self.least[:-1]):
            right = node | 1
            found = going & (node % 2 == 0) & (least[np.minimum(right, len(least) - 1)] <= aim)
            node, level = np.where(found, right, node), np.where(found, h, level)
            going &= ~found
            node = np.where(going, node // 2, node)
        for h in range(len(self.least) - 2, -1, -1):
            below = level == h + 1
            left = np.minimum(node * 2, len(self.least[h]) - 1)
            node = np.where(below, left + (self.least[h][left] > aim), node)
            level = np.where(below, h, level)
        out[far] = node * BLOCK + (self.blocks[node] <= aim[:, None]).argmax(1)
        return out


#: Per node of a path: members, smallest member, final children, leaves and savings of final nodes below it, code points of its last text.
WEIGHTS = ("members", "low", "children", "leaves", "saved", "size")
NEVER = np.iinfo(np.int64).max


class Trie:
    """A shard: sorted paths with weights for each of their nodes.

    ``paths`` are digests joined, ``weights[w]`` has the values of weight w of all nodes of all paths, root first. With
    ``whole`` no other shard exists, so there is no spine.
    """

    def __init__(self, paths: list[str], weights: dict[str, np.ndarray], whole: bool):
        lengths = np.array([len(p) // WIDTH for p in paths])
        shared = np.array([0, *map(_common, paths, paths[1:])])
        shared[0] = -1
        fresh = lengths - shared                        # nodes first met on a path; its first one is a child of a known node
        starts = np.cumsum(fresh) - fresh
        n = int(fresh.sum())
        self.paths, self.lengths = paths, lengths
        self.depth = np.arange(n) - np.repeat(starts - shared - 1, fresh)
        # node of every place of every path
        chain = np.zeros(lengths.max() + 1, np.int64)
        places, self.parent = [], np.full(n, -1)
        for start, old, length in zip(starts.tolist(), shared.tolist(), lengths.tolist()):
            chain[old + 1:length + 1] = np.arange(start, start + length - old)
            self.parent[start:start + length - old] = chain[np.arange(old, length)] if old >= 0 else [-1, *chain[:length]]
            places.append(chain[:length + 1].copy())
        self.places, self.ends = places, np.array([p[-1] for p in places])
        node = np.concatenate(places)
        self.size = np.zeros(n, np.int64)
        self.size[node] = weights["size"]
        self.low = np.full(n, NEVER)
        np.minimum.at(self.low, node, weights["low"])
        self.members, self.children, leaves, saved = (_sum(node, weights[w], n) for w in ("members", "children", "leaves", "saved"))
        np.add.at(self.children, self.parent[1:], 1)
        # opening parentheses of a path's new nodes stand behind the closing ones of the nodes it leaves
        closing = np.append(lengths[:-1] - shared[1:], lengths[-1] + 1)
        opening = np.repeat(np.tile([True, False], len(paths)), np.stack([fresh, closing], 1).ravel())
        bits = Parentheses(opening)
        self.open = np.flatnonzero(opening)
        self.close = bits.findclose(self.open)
        self.last = np.searchsorted(self.open, self.close)      # the first node behind the subtree
        self.spine = np.zeros(n, bool)
        if not whole:
            self.spine[places[0]] = self.spine[places[-1]] = True
        # a node without children in this trie is a leaf if it has none that are final already
        final = ~self.spine
        bare = self.last == np.arange(n) + 1
        rank = lambda place: np.where(place > 0, bits.pairs[np.maximum(place - 1, 0)], 0)
        more = leaves - (bare & ~(final & (self.children == 0)))
        self.leaves = rank(self.close) - rank(self.open) + _between(more, self.last)
        self.saved = _between(saved + np.where(final, (self.members - 1) * self.size, 0), self.last)
        # what lies below the final children of a spine node stays with it on the next level
        if not whole:
            top = np.flatnonzero(final & self.spine[self.parent])
            self.kept = {"children": _sum(node, weights["children"], n), "leaves": leaves.copy(), "saved": saved.copy()}
            for name, value in (("children", np.ones(n, np.int64)), ("leaves", self.leaves), ("saved", self.saved)):
                np.add.at(self.kept[name], self.parent[top], value[top])

    def spine_paths(self) -> list[tuple[str, dict[str, np.ndarray]]]:
        """The first and the last path; nodes of both have their weights in the first."""
        value = {"members": self.members, "low": self.low, "size": self.size, **self.kept}
        first, last = self.places[0], self.places[-1]
        out = [(self.paths[0], {w: value[w][first] for w in WEIGHTS})]
        same = _common(self.paths[0], self.paths[-1]) + 1
        if same < len(last):
            tail = {w: value[w][last] for w in WEIGHTS}
            for w in WEIGHTS:
                if w != "size":
                    tail[w][:same] = NEVER if w == "low" else 0
            out.append((self.paths[-1], tail))
        return out


def _common(a: str, b: str) -> int:
    """Turns that two paths share."""
    m = min(len(a), len(b)) // WIDTH
    if a[:m * WIDTH] == b[:m * WIDTH]:
        return m
    x, y = (np.frombuffer(p[:m * WIDTH].encode("ascii"), np.dtype(f"S{WIDTH}")) for p in (a, b))
    return int((x != y).argmax())


def _sum(node: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, node, values)
    return out


def _between(values: np.ndarray, last: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[last] - sums[:-1]


def _keys(path: str) -> list[bytes]:
    """Digests that name the nodes of a path, root first."""
    running = hashlib.sha256()
    out = [running.digest()]
    for at in range(0, len(path), WIDTH):
        running.update(path[at:at + WIDTH].encode())
        out.append(running.digest())
    return out


#: ``kind``: 0 a final node, 1 a path of the next level, 2 members that end in a spine node, their ids joined.
ROWS = ("kind int, place long, conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, n_children long, n_leaves long, "
        f"saved_tokens long, ends string, path string, {', '.join(f'{w} array<long>' for w in WEIGHTS)}")


NAMES = [c.split()[0] for c in ROWS.split(", ")]
KINDS = [pa.int32(), *[pa.int64()] * 4, pa.binary(), pa.binary(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.list_(pa.int64())] * len(WEIGHTS)]


def _rows(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(NAMES, KINDS)], names=NAMES)


def _shard(batch: pa.Table, place: int, whole: bool, base: bool) -> Iterator[pa.RecordBatch]:
    own = batch.column("path").to_pylist()
    ends: dict[int, str] = {}
    if base:
        conv, lengths = batch.column("conv_id").to_numpy(), np.array([len(p) // WIDTH for p in own])
        texts = np.insert(batch.column("sizes").combine_chunks().flatten().to_numpy(), np.cumsum(lengths) - lengths, 0)
        none = np.zeros(len(texts), np.int64)
        trie = Trie(own, {"members": none + 1, "low": np.repeat(conv, lengths + 1), "children": none, "leaves": none, "saved": none, "size": texts}, whole)
        turn = np.flatnonzero(np.append(True, trie.ends[1:] != trie.ends[:-1]))
        ends = {int(trie.ends[s]): ",".join(map(str, conv[s:e].tolist())) for s, e in zip(turn, np.append(turn[1:], len(own)))}
    else:
        trie = Trie(own, {w: batch.column(w).combine_chunks().flatten().to_numpy() for w in WEIGHTS}, whole)
    keys: dict[int, bytes] = {}
    for i in (0, len(own) - 1) if base else range(len(own)):
        keys |= zip(trie.places[i].tolist(), _keys(own[i]))
    some = np.flatnonzero(~trie.spine)
    if len(some):
        parent = trie.parent[some]
        known = (parent >= 0) & ~trie.spine[parent]
        mine = {"ends": [hashlib.sha256(ends.get(v, "").encode()).hexdigest() for v in some.tolist()]} if base else {"key": [keys[v] for v in some.tolist()]}
        yield _rows(len(some), kind=np.zeros(len(some), np.int32), conv_id=trie.low[some], depth=trie.depth[some],
                    parent_conv_id=[low if k else None for low, k in zip(trie.low[parent].tolist(), known.tolist())],
                    parent_key=[None if k or p < 0 else keys[p] for p, k in zip(parent.tolist(), known.tolist())],
                    n_convs=trie.members[some], n_children=trie.children[some], n_leaves=trie.leaves[some], saved_tokens=trie.saved[some], **mine)
    if not whole:
        spine = trie.spine_paths()
        yield _rows(len(spine), kind=[1] * len(spine), place=[place * 2 + i for i in range(len(spine))], path=[p for p, _ in spine],
                    **{w: [v[w] for _, v in spine] for w in WEIGHTS})
        held = [v for v in ends if trie.spine[v]]
        if held:
            yield _rows(len(held), kind=[2] * len(held), place=[place] * len(held), key=[keys[v] for v in held], ends=[ends[v] for v in held])


def _level(paths: DataFrame, whole: bool, base: bool) -> DataFrame:
    """``ROWS`` of every shard of sorted ``paths``; ``base`` paths are conversations, others have weights."""
    size, few = (SHARD, 2) if base else (SPINES, FEW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, nodes, count = TaskContext.get().partitionId() << 32, [], 0, 0
        for batch in batches:
            ends = np.cumsum([len(p) // WIDTH + 1 for p in batch.column("path").to_pylist()])
            at = 0
            while at < len(batch):
                used = ends[at - 1] if at else 0
                to = min(max(int(np.searchsorted(ends, used + size - nodes, "right")), at + 1), len(batch))
                held.append(batch.slice(at, to - at))
                nodes, count, at = nodes + int(ends[to - 1] - used), count + to - at, to
                if nodes >= size and count >= few and not whole:
                    yield from _shard(pa.Table.from_batches(held), place, whole, base)
                    place, held, nodes, count = place + 1, [], 0, 0
        if held:
            yield from _shard(pa.Table.from_batches(held), place, whole, base)

    return paths.mapInArrow(run, ROWS)


def _joined_ids(parts: DataFrame) -> DataFrame:
    """(key, ends_sha256): the digest over all parts of a key, in the order of their shards, a part at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], names=["key", "ends_sha256"])
        for batch in batches:
            for k, text in zip(batch.column("key"), batch.column("ends")):
                if k.as_py() != key:
                    if running:
                        yield done()
                    key, running = k.as_py(), hashlib.sha256(text.as_py().encode())
                else:
                    running.update(f",{text.as_py()}".encode())
        if running:
            yield done()

    return parts.repartition("key").sortWithinPartitions("key", "place").select("key", "ends").mapInArrow(run, "key binary, ends_sha256 string")


def nodes(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of ``conversations`` (conv_id, path, sizes), of which each conv_id has one.

    conv_id: the smallest member, a conversation that begins with the node's turns. depth: their number. parent_conv_id:
    the parent's conv_id, null for the root. n_convs, n_children: members, child nodes. n_leaves: nodes without children
    in the subtree, itself included. saved_tokens: code points saved in the subtree where every node's last text is kept
    once. ends_sha256: digest of the members that end in the node, in rising order, joined by commas.

    Conversations without turns are members of the root. Without any conversation there is no node. A shard is held by
    one task; a conversation's path of 40 bytes a turn is never divided.
    """
    level = stage(conversations.select("conv_id", "path", "sizes"), "paths")
    steps = F.expr(f"length(path) div {WIDTH} + 1")
    final, base, before = [], True, None
    while True:
        count, total = level.agg(F.count(F.lit(1)), F.coalesce(F.sum(steps), F.lit(0))).first()
        # one shard holds the rest when it is small, or cannot shrink as every task has a few paths only
        whole = not base and (total <= SPINES or count <= FEW or (before is not None and 2 * count > before))
        order = ["path", "conv_id"] if base else ["place"]
        parts = 1 if whole else -(-total // (SHARD if base else SPINES)) or 1
        placed = level.coalesce(1) if parts == 1 else level.repartitionByRange(parts, *order)
        found = stage(_level(placed.sortWithinPartitions(*order), whole, base), "trie-level")
        final.append(found.where("kind = 0"))
        if base:
            ends = stage(_joined_ids(found.where("kind = 2")), "spine-ends")
        if whole or not count:
            break
        before, base = (None if base else count), False
        level = found.where("kind = 1").select("place", "path", *WEIGHTS)
    named = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    shared = final[0].limit(0)
    for part in final[1:]:
        shared = shared.unionByName(part)
    shared = shared.drop("ends").join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
    inner = final[0].withColumnRenamed("ends", "ends_sha256")
    every = inner.select("parent_key", *named).unionByName(shared.select("parent_key", *named))
    parents = shared.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    below = every.where("parent_key IS NOT NULL").join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return every.where("parent_key IS NULL").select(*named).unionByName(below.select(*named))
