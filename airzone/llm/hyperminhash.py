"""Near-duplicate documents by HyperMinHash registers, bands and a check on whole shingle sets.

A document's shingle hashes are dealt into buckets by their leading bits. A bucket keeps only its smallest
hash, as the count of leading zeros and the mantissa bits that follow them: a register. Documents that share
a band of registers are candidates, an estimate from all registers (less the register collisions expected by
chance) drops clear misses, and every link is confirmed on the two whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import components, only, picked
from airzone.sources.tables import stage

MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sketch:
    """``2**index_bits`` registers of a zero count and ``mantissa_bits`` bits; ``rows`` registers make a band.

    With 128 registers and 4 rows, a pair of similarity 0.85 shares none of its 32 bands once in 10**10.
    ``slack`` is how far below the threshold an estimate may fall, in standard deviations, before the pair
    is dropped without a look at its sets.
    """

    width: int = 3
    numerator: int = 85
    denominator: int = 100
    index_bits: int = 7
    mantissa_bits: int = 10
    rows: int = 4
    slack: float = 6.0

    @property
    def registers(self) -> int:
        return 1 << self.index_bits

    @property
    def similarity(self) -> float:
        return self.numerator / self.denominator


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of UTF-8 text.

    bytes.lower changes A-Z only and bytes.split divides at the ASCII white space of the contract. Fewer
    words than ``width`` are one shingle; no word gives none.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), np.uint64)
    span = min(width, len(words))
    total = np.zeros(len(words) - span + 1, np.uint64)
    for i in range(span):
        total = _mixed(total * MIX + hashes[i:len(hashes) - span + 1 + i])
    total = np.sort(total + np.uint64(span))
    return total[np.flatnonzero(np.diff(total, prepend=~total[:1]))]


def registers_of(hashes: np.ndarray, sketch: Sketch) -> np.ndarray:
    """One 16-bit register per bucket: zero count above the mantissa, plus one; 0 where the bucket is empty."""
    free = 64 - sketch.index_bits
    bucket = (hashes >> np.uint64(free)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    smallest = hashes[first] & np.uint64((1 << free) - 1)
    # exponent of the leading one: float conversion may round up to the next power, so it is checked
    _, exponent = np.frexp(smallest.astype(np.float64))
    exponent = np.where((smallest >> np.maximum(exponent - 1, 0).astype(np.uint64)) == 0, exponent - 1, exponent)
    zeros = np.minimum(free - exponent, 62)
    below = (smallest << (zeros + 1 + sketch.index_bits).clip(0, 63).astype(np.uint64)) >> np.uint64(64 - sketch.mantissa_bits)
    out = np.zeros(sketch.registers, np.uint16)
    out[bucket[first]] = (zeros.astype(np.uint64) * np.uint64(1 << sketch.mantissa_bits) + below + np.uint64(1)).astype(np.uint16)
    return out


def expected_collisions(n: np.ndarray, m: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Registers that two unrelated sets of ``n`` and ``m`` shingles share by chance.

    At zero count i the hash range [2**-(i+1), 2**-i) has 2**mantissa_bits cells. The smallest of a shingles
    of a bucket has the density a * (1 - x)**(a - 1), so the chance that both minima fall into one cell is the
    cell width times the integral of the two densities over the range, summed over all ranges. A filled bucket
    has one shingle at least.
    """
    a, b = np.maximum(n / sketch.registers, 1), np.maximum(m / sketch.registers, 1)
    power = (a + b - 1)[..., None]
    low, high = 0.5 ** np.arange(1, 58), 0.5 ** np.arange(57)
    mass = (1 - low) ** power - (1 - high) ** power
    chance = (mass * low / 2 ** sketch.mantissa_bits).sum(-1) * a * b / power[..., 0]
    return sketch.registers * np.clip(chance, 0, 1)


def estimated_jaccard(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of every row of registers ``x`` to the same row of ``y``, and the number of filled registers."""
    same, filled = ((x == y) & (x > 0)).sum(1), np.maximum(((x > 0) | (y > 0)).sum(1), 1)
    chance = expected_collisions(n.astype(float), m.astype(float), sketch) * filled / sketch.registers
    return np.clip((same - chance) / np.maximum(filled - chance, 1e-9), 0, 1), filled


def plausible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, sketch: Sketch) -> np.ndarray:
    """Rows whose estimate allows the wanted similarity. Equal registers less those by chance are no more than the equal
    ones, so the chance is worked out for rows only that pass without it."""
    same, filled = ((x == y) & (x > 0)).sum(1), np.maximum(((x > 0) | (y > 0)).sum(1), 1)
    least = sketch.similarity - sketch.slack * np.sqrt(sketch.similarity * (1 - sketch.similarity) / filled)
    out = same >= least * filled
    left = np.flatnonzero(out)
    out[left] = estimated_jaccard(x[left], y[left], n[left], m[left], sketch)[0] >= least[left]
    return out


def agreement(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Equal filled registers, and registers filled on either side, of every row of ``x`` with every row of ``y``."""
    empty = np.iinfo(x.dtype).max          # no register is that large, so an empty one equals nothing
    right = np.where(y > 0, y, empty)
    if len(x) * len(y) <= 2048:
        same = (x[:, None, :] == right[None, :, :]).sum(2)
    else:
        same = np.zeros((len(x), len(y)), np.uint8 if x.shape[1] < 256 else np.uint16)
        for a, b in zip(np.ascontiguousarray(x.T), np.ascontiguousarray(right.T)):
            same += a[:, None] == b[None, :]
    fx, fy = (x > 0).astype(np.float32), (y > 0).astype(np.float32)
    return same, (fx.sum(1)[:, None] + fy.sum(1)[None, :] - fx @ fy.T).round().astype(np.int64)


def plausible_pairs(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, allowed: np.ndarray, sketch: Sketch) -> tuple[np.ndarray, np.ndarray]:
    """(row of ``x``, row of ``y``) of the ``allowed`` pairs for which ``plausible`` holds."""
    same, filled = agreement(x, y)
    sizes = np.maximum(np.arange(sketch.registers + 1), 1)
    least = sketch.similarity - sketch.slack * np.sqrt(sketch.similarity * (1 - sketch.similarity) / sizes)
    i, j = np.nonzero(allowed & (same >= (least * sizes)[filled]))
    kept = [plausible(x[i[at:at + 16_384]], y[j[at:at + 16_384]], n[i[at:at + 16_384]], m[j[at:at + 16_384]], sketch) for at in range(0, len(i), 16_384)]
    close = np.concatenate(kept) if kept else np.empty(0, bool)
    return i[close], j[close]


def linked(a: np.ndarray, b: np.ndarray, sketch: Sketch) -> bool:
    """Whether two sorted sets reach the similarity, by whole numbers."""
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return sketch.denominator * shared >= sketch.numerator * (len(a) + len(b) - shared)


SETS = "doc_id long, n_shingles long, set_id binary, registers binary"


def sketches(docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(doc_id, n_shingles, set_id, registers) of every row; the last two are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, ids, found = [], [], []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py(), sketch.width)
                sizes.append(len(hashes))
                ids.append(xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else None)
                found.append(registers_of(hashes, sketch).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()), pa.array(found, pa.binary())],
                names=["doc_id", "n_shingles", "set_id", "registers"])

    return docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(run, SETS)


def _bands(nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """(band, node): one row for every band with a filled register; the band's number is part of its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(len(batch), -1, sketch.rows)
            row, band = np.nonzero(blocks.any(2))
            packed = np.zeros(len(row), np.uint64)
            for i in range(sketch.rows):
                packed = _mixed(packed * MIX + blocks[row, band, i])
            packed = _mixed(packed * MIX + band.astype(np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(packed.view(np.int64)), batch.column(0).take(pa.array(row))], names=["band", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "band long, node long")


PAIRS = "tile long, lefts array<long>, rights array<long>"


def _led(bands: DataFrame) -> DataFrame:
    """(node, leader): the smallest node of every band that a node shares with others."""
    leaders = bands.groupBy("band").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("members")).where("members > 1")
    return bands.join(leaders, "band").where("node != leader").select("node", "leader").distinct()


def _leader_pairs(pairs: DataFrame, nodes: DataFrame, sketch: Sketch) -> DataFrame:
    """The plausible ones of some (node, leader) pairs, packed by tile.

    A tile holds pairs of one leader, about ``BLOCK`` at most: a leader of more nodes is dealt over as many tiles as that takes.
    """
    mine = nodes.select(F.col("node"), F.col("n_shingles").alias("n"), F.col("registers").alias("r"))
    theirs = nodes.select(F.col("node").alias("leader"), F.col("n_shingles").alias("m"), F.col("registers").alias("q"))
    fits = F.least("n", "m") * sketch.denominator >= F.greatest("n", "m") * sketch.numerator
    found = (pairs.join(nodes.select("node", F.col("n_shingles").alias("n")), "node")
             .join(nodes.select(F.col("node").alias("leader"), F.col("n_shingles").alias("m")), "leader").where(fits)
             .select("node", "leader").join(mine, "node").join(theirs, "leader"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(len(batch), -1) for i in ("r", "q"))
            n, m = (batch.column(i).to_numpy().astype(float) for i in ("n", "m"))
            yield batch.select(["node", "leader"]).filter(pa.array(plausible(x, y, n, m, sketch)))

    kept = stage(found.select("node", "leader", "n", "m", "r", "q").mapInArrow(run, "node long, leader long"), "leader-pairs")
    crowds = kept.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks")).where("blocks > 1")
    dealt = picked(kept, crowds, "leader", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    return (dealt.groupBy(F.xxhash64("leader", F.pmod(F.xxhash64("node"), "blocks")).alias("tile"))
            .agg(F.collect_list("node").alias("lefts"), F.collect_list("leader").alias("rights")))


def _leader_links(bands: DataFrame, nodes: DataFrame, docs: DataFrame, sketch: Sketch) -> DataFrame:
    """Links of nodes with leaders, in two rounds: every node meets its smallest leader first, and its other leaders only
    as far as the first round has not joined them. So most of a crowd of copies costs one comparison a node, not one a band."""
    led = stage(_led(bands), "led")
    first = led.groupBy("node").agg(F.min("leader").alias("leader"))
    links = stage(_confirmed(_leader_pairs(first, nodes, sketch), nodes, docs, sketch), "first-links")
    groups = stage(components(links), "first-groups")
    mine, theirs = groups.withColumnRenamed("component", "c"), groups.withColumnsRenamed({"node": "leader", "component": "d"})
    others = (led.join(first.withColumnRenamed("leader", "met"), "node").where("leader != met").join(mine, "node", "left").join(theirs, "leader", "left")
              .where(F.coalesce("c", "node") != F.coalesce("d", "leader")).select("node", "leader"))
    return links.unionByName(stage(_confirmed(_leader_pairs(others, nodes, sketch), nodes, docs, sketch), "leader-links"))


BLOCK = 256
#: Nodes, and shingle hashes (3 MB), that share a home at most: two homes meet in a tile, so fewer of them move fewer sets.
HOME, HASHES = 1024, 400_000


def _open_pairs(bands: DataFrame, nodes: DataFrame, groups: DataFrame, sketch: Sketch) -> DataFrame:
    """Plausible pairs of nodes that share a band but not yet a component, packed by tile.

    A band's largest component is never compared with itself: it is dealt into blocks of ``BLOCK`` nodes that the
    band's other nodes visit, and these are compared with one another block by block. So a crowd of copies costs one row
    a node, and rows multiply only with the nodes that stand outside it. A pair is looked at only in the first band
    that it shares. ``home`` (the smallest leader of a node's open bands) and a block number decide the tile in which
    a pair's sets will meet, so a node's set travels to few tiles however many pairs it has.
    """
    placed = bands.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_bands = (placed.groupBy("band").agg(F.min("node").alias("leader"), F.min("component").alias("low"), F.max("component").alias("high"))
                  .where("low != high").select("band", "leader"))
    inside = stage(placed.join(open_bands, "band"), "open-bands")
    homes = inside.groupBy("node").agg(F.min("leader").alias("home"))
    crowd = (homes.join(nodes.select("node", "n_shingles"), "node").groupBy("home")
             .agg(F.ceil(F.greatest(F.count(F.lit(1)) / HOME, F.sum("n_shingles") / HASHES)).cast("long").alias("blocks")))
    homes = homes.join(crowd, "home").select("node", F.xxhash64("home", F.pmod(F.xxhash64("node"), "blocks")).alias("home"))
    known = nodes.select("node", "n_shingles", "registers").join(homes, "node")
    shares = (inside.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("band")
              .agg(F.max(F.struct("n", "component")).alias("top"), F.sum("n").alias("members"))
              .select("band", F.col("top.component").alias("main"), F.ceil(F.col("top.n") / BLOCK).alias("mains"),
                      F.ceil((F.col("members") - F.col("top.n")) / BLOCK).alias("others")))
    deal = F.expr("""explode(if(component = main,
        transform(sequence(0, others - 1), i -> struct(true AS mixed, part AS one, i AS two)),
        concat(transform(sequence(0, mains - 1), i -> struct(true AS mixed, i AS one, part AS two)),
               transform(sequence(0, others - 1), i -> struct(false AS mixed, least(i, part) AS one, greatest(i, part) AS two)))))""")
    rows = (inside.join(shares, "band").withColumn("in_main", F.col("component") == F.col("main"))
            .withColumn("part", F.expr("pmod(xxhash64(node, 7), if(component = main, mains, others))"))
            .select("band", "node", "component", "part", "in_main", deal.alias("t"))
            .join(known, "node")
            .select("band", "t.mixed", "t.one", "t.two", "node", "component", "part", "in_main", "n_shingles", "registers", "home"))

    tiles = ["band", "mixed", "one", "two"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None                     # rows of the last tile, which may go on in the next batch
        for batch in batches:
            table = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            keys = [table.column(c).to_numpy() for c in tiles]
            last = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield _compared(table.slice(0, cut), tiles, sketch)
            held = table.slice(cut).to_batches()[0]
        if held is not None and len(held):
            yield _compared(pa.Table.from_batches([held]), tiles, sketch)

    return rows.repartition(*tiles).sortWithinPartitions(*tiles).mapInArrow(run, PAIRS)


#: Tiles of more pairs are compared as a matrix, the others together.
SMALL = 2048


def _compared(rows: pa.Table, tiles: list[str], sketch: Sketch) -> pa.RecordBatch:
    """Plausible pairs of whole tiles, sorted by tile, that meet here first, packed by the tile in which their sets will meet."""
    band, mixed, one, two = (rows.column(c).to_numpy() for c in tiles)
    node, comp, part, n, home, main = (rows.column(c).to_numpy() for c in ("node", "component", "part", "n_shingles", "home", "in_main"))
    regs = np.frombuffer(b"".join(rows.column("registers").to_pylist()), np.uint16).reshape(len(node), -1)
    starts = np.flatnonzero(np.r_[True, (band[1:] != band[:-1]) | (mixed[1:] != mixed[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
    tile = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(node)]))
    left, right = np.flatnonzero(np.where(mixed, main, part == one)), np.flatnonzero(np.where(mixed, ~main, part == two))
    lefts, rights = np.bincount(tile[left], minlength=len(starts)), np.bincount(tile[right], minlength=len(starts))
    left_at, right_at = np.cumsum(lefts) - lefts, np.cumsum(rights) - rights

    def allowed(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        near = sketch.denominator * np.minimum(n[i], n[j]) >= sketch.numerator * np.maximum(n[i], n[j])
        return near & (comp[i] != comp[j]) & (mixed[i] | (one[i] != two[i]) | (node[i] < node[j]))

    found = []
    few = left[(lefts * rights)[tile[left]] <= SMALL]
    times = rights[tile[few]]
    i = np.repeat(few, times)
    j = right[np.repeat(right_at[tile[few]] - (np.cumsum(times) - times), times) + np.arange(len(i))]
    ok = allowed(i, j)
    i, j = i[ok], j[ok]
    for at in range(0, len(i), 16_384):
        x, y = i[at:at + 16_384], j[at:at + 16_384]
        close = plausible(regs[x], regs[y], n[x], n[y], sketch)
        found.append((x[close], y[close]))
    for t in np.flatnonzero(lefts * rights > SMALL):
        x, y = left[left_at[t]:left_at[t] + lefts[t]], right[right_at[t]:right_at[t] + rights[t]]
        p, q = plausible_pairs(regs[x], regs[y], n[x], n[y], allowed(x[:, None], y[None, :]), sketch)
        found.append((x[p], y[q]))
    i, j = (np.concatenate([f[side] for f in found] or [np.empty(0, np.int64)]) for side in (0, 1))
    here = np.empty(len(i), bool)
    for at in range(0, len(i), 16_384):
        some = slice(at, at + 16_384)
        x, y = (regs[k[some]].reshape(-1, sketch.registers // sketch.rows, sketch.rows) for k in (i, j))
        first = ((x == y).all(2) & x.any(2)).argmax(1)
        packed = np.zeros(len(first), np.uint64)
        for k in range(sketch.rows):
            packed = _mixed(packed * MIX + x[np.arange(len(first)), first, k])
        here[some] = _mixed(packed * MIX + first.astype(np.uint64)).view(np.int64) == band[i[some]]
    i, j = i[here], j[here]
    i, j = np.where(home[i] <= home[j], i, j), np.where(home[i] <= home[j], j, i)
    order = np.lexsort((home[j], home[i]))
    i, j = i[order], j[order]
    at = np.flatnonzero(np.r_[len(i) > 0, (home[i][1:] != home[i][:-1]) | (home[j][1:] != home[j][:-1])]) if len(i) else np.empty(0, np.int64)
    names = [xxhash.xxh3_64_intdigest(np.array([home[i[k]], home[j[k]]]).tobytes()) - (1 << 63) for k in at]
    ends = pa.array(np.r_[at, len(i)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), *(pa.ListArray.from_arrays(ends, pa.array(node[k], pa.int64())) for k in (i, j))],
                                      names=["tile", "lefts", "rights"])


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, sketch: Sketch) -> DataFrame:
    """(a, b) of the packed pairs whose whole sets are similar enough.

    Each tile's sets are brought to it once. Inside a tile, ends that links already join are not compared again.
    """
    pairs = stage(pairs, "pairs")
    wanted = pairs.select(F.col("tile").alias("place"), F.explode(F.array_distinct(F.concat("lefts", "rights"))).alias("node")).distinct()
    needed = stage(wanted.select("node").distinct().join(nodes.select("node", "doc_id", "set_id"), "node"), "needed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(text.as_py(), sketch.width).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("set_id"), pa.array([xxhash.xxh3_128_digest(s) for s in sets], pa.binary()),
                 pa.array(sets, pa.binary())], names=["node", "set_id", "own", "hashes"])

    texts = picked(docs, needed, "doc_id").select("node", "set_id", F.col("text").cast("binary").alias("text"))
    sets = (texts.mapInArrow(run, "node long, set_id binary, own binary, hashes binary")
            .where("set_id = own").select("node", "hashes"))

    def confirm(chosen: pa.Table, members: pa.Table) -> pa.Table:
        of = {k: np.frombuffer(v, np.uint64) for k, v in zip(members.column("node").to_pylist(), members.column("hashes").to_pylist())}
        root = {k: k for k in of}

        def top(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        out = []
        for lefts, rights in zip(chosen.column("lefts"), chosen.column("rights")):
            for a, b in zip(lefts.as_py(), rights.as_py()):
                if top(a) != top(b) and linked(of[a], of[b], sketch):
                    root[top(a)] = top(b)
                    out.append((a, b))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})

    members = wanted.join(sets, "node").select("place", "node", "hashes")
    return pairs.groupBy("tile").cogroup(members.groupBy("place")).applyInArrow(confirm, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch: Sketch = Sketch()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    Equal sets are one node. Every node is first compared with the smallest nodes of its bands, as far as it is not yet
    joined with them; pairs of nodes that share a band and are still in different components are compared next. As only connection counts,
    a group of copies costs about one comparison per copy, and no link between different sets is lost but by the
    chance stated at ``Sketch``.

    Null or empty text has no set and links with nothing. Rows that share an id are one document: a link of any of
    them links all. A row with a null id has a null component and is kept. An empty table gives no row.
    """
    docs = only(docs, doc_id=docs[id_col].cast("long"), text=text_col)
    found = stage(sketches(docs, sketch), "sketches")
    groups = found.where("set_id IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_id").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n_shingles"), F.min("registers").alias("registers"))
    nodes = stage(groups.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = stage(_bands(nodes, sketch), "bands")
    links = _leader_links(bands, nodes, docs, sketch)
    more = stage(_confirmed(_open_pairs(bands, nodes, components(links), sketch), nodes, docs, sketch), "open-links")
    every = links.unionByName(more)
    ids = nodes.select(F.col("node"), F.col("doc_id").alias("rep"))
    between = (every.join(ids.withColumnsRenamed({"node": "a", "rep": "x"}), "a")
               .join(ids.withColumnsRenamed({"node": "b", "rep": "y"}), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    copies = (found.join(nodes.select("set_id", F.col("doc_id").alias("rep")), "set_id")
              .where("doc_id != rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    joined = components(between.unionByName(copies))
    return (found.select("doc_id", "n_shingles").join(joined, F.col("doc_id") == F.col("node"), "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))
