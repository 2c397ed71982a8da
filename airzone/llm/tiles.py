"""Near-duplicate embeddings: tiles of vectors, compared along principal components with early termination."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from airzone.llm.common import components, only
from airzone.sources.tables import stage


@dataclass(frozen=True)
class Tiling:
    """Cosine wanted; rows of a tile's side; dimensions added per step, doubled after each step; components that make cells."""

    cosine: float = 0.98
    block: int = 1024
    step: int = 8
    axes: int = 2


#: Room for rounding in the rotated space; every pair it lets through is settled on the given components.
ROUNDING = 1e-9
#: Pairs of a tile that are followed beyond the first step at a time.
STRIP = 50_000


def _rows(vectors: DataFrame) -> DataFrame:
    """Every row with its vector as double bytes and a digest of them, both null where the vector links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, digests = [], []
            for label, values in zip(batch.column("label").to_pylist(), batch.column("vector")):
                x = np.array(values.as_py() or [], dtype=np.float64) if label is not None else np.empty(0)
                if x.size and np.isfinite(x).all() and x.any():      # a null component has become NaN
                    data = (x + 0.0).tobytes()                       # one zero
                    packed.append(data)
                    digests.append(xxhash.xxh3_128_digest(data))
                else:
                    packed.append(None)
                    digests.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(packed, pa.binary()), pa.array(digests, pa.binary())],
                names=["vec_id", "label", "vector", "digest"])

    return vectors.mapInArrow(run, "vec_id long, label string, vector binary, digest binary")


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, without overflow for very large components."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def principal_axes(nodes: DataFrame, size: int) -> np.ndarray:
    """Eigenvectors of the second moments of all unit vectors of ``size`` components, the largest first.

    Every task sums its own products; ``size * size`` sums are added up and read by the driver, however many rows there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = unit(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.float64).reshape(-1, size)) if len(batch) else np.empty((0, size))
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(size * size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"])

    sums = (nodes.where(F.length("vector") == 8 * size).select("vector").mapInArrow(run, "cell int, value double")
            .groupBy("cell").agg(F.sum("value").alias("value")).collect())
    moments = np.zeros(size * size)
    for cell, value in sums:
        moments[cell] = value
    _, axes = np.linalg.eigh(moments.reshape(size, size))
    return np.ascontiguousarray(axes[:, ::-1])


def similar(x: np.ndarray, y: np.ndarray, axes: np.ndarray, tiling: Tiling) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the rows of ``x`` and ``y`` with the wanted cosine.

    Products are added up along the leading axes first. What the other axes can still add is at most the product
    of the two suffix norms, so a pair is dropped as soon as sum and bound together stay below the cosine.
    """
    u, v = unit(x) @ axes, unit(y) @ axes
    at = min(tiling.step, u.shape[1])
    least = tiling.cosine - ROUNDING
    tail = lambda w, k: np.sqrt((w[:, k:] ** 2).sum(axis=1))
    total = u[:, :at] @ v[:, :at].T
    i, j = np.nonzero(total + np.multiply.outer(tail(u, at), tail(v, at)) >= least)
    total, found = total[i, j], [(i[:0], j[:0])]
    for some in range(0, len(i), STRIP):        # memory of a strip of pairs, also where every pair of a tile is close
        found.append(_settled(x, y, u, v, i[some:some + STRIP], j[some:some + STRIP], total[some:some + STRIP], at, tiling))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _settled(x, y, u, v, i, j, total, at: int, tiling: Tiling) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i, j) with the wanted cosine, given their products along the first ``at`` axes."""
    size, step, least = u.shape[1], tiling.step, tiling.cosine - ROUNDING
    tail = lambda w, k: np.sqrt((w[:, k:] ** 2).sum(axis=1))
    while at < size and len(i):
        step *= 2
        to = min(at + step, size)
        total = total + np.einsum("ij,ij->i", u[i, at:to], v[j, at:to])
        at = to
        keep = total + tail(u, at)[i] * tail(v, at)[j] >= least
        i, j, total = i[keep], j[keep], total[keep]
    a, b = x[i] / np.abs(x[i]).max(axis=1, keepdims=True, initial=1e-300), y[j] / np.abs(y[j]).max(axis=1, keepdims=True, initial=1e-300)
    dot = (a * b).sum(axis=1)
    keep = dot / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))) >= tiling.cosine
    return i[keep], j[keep]


def _cells(nodes: DataFrame, axes: dict[int, np.ndarray], tiling: Tiling) -> DataFrame:
    """The cell of every node: its leading components in steps of the longest chord between two linked unit vectors."""
    chord = float(np.sqrt(2 - 2 * tiling.cosine)) * (1 + 1e-6) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = []
            for data in batch.column("vector").to_pylist():
                x = unit(np.frombuffer(data, np.float64)[None, :])
                lead = x @ axes.get(x.shape[1], np.eye(x.shape[1]))[:, :tiling.axes]
                cells.append(np.pad(np.floor(lead[0] / chord).astype(int), (0, tiling.axes - lead.shape[1])).tolist())
            yield pa.RecordBatch.from_arrays([*batch.select(["node", "label", "members", "vector"]).columns,
                                              pa.array(cells, pa.list_(pa.int32()))],
                                             names=["node", "label", "members", "vector", "cell"])

    return (nodes.select("node", "label", "members", "vector")
            .mapInArrow(run, "node long, label string, members long, vector binary, cell array<int>")
            .withColumn("size", F.length("vector")))


TILE = ["label", "size", "one", "two", "i", "j"]


def _tiles(cells: DataFrame, tiling: Tiling) -> DataFrame:
    """Every node once per tile it takes part in; a tile joins a block of one cell with a block of it or of a cell beside it."""
    place = ["label", "size", "cell"]
    parts = cells.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / tiling.block).cast("long").alias("parts"))
    shifts = "array(cast(array() AS array<int>))"
    for axis in range(tiling.axes):
        shifts = f"flatten(transform({shifts}, s -> transform(sequence(-1, 1), d -> array_append(s, cell[{axis}] + d))))"
    beside = parts.withColumnsRenamed({"cell": "near", "parts": "near_parts"})
    reach = (parts.select(*place, "parts", F.explode(F.expr(shifts)).alias("near"))
             .join(beside, ["label", "size", "near"]))
    rows = cells.join(reach, place).withColumn("part", F.expr("pmod(xxhash64(node), parts)"))
    dealt = rows.withColumn("other", F.explode(F.expr("sequence(0, near_parts - 1)")))
    first = F.expr("cell < near OR (cell = near AND part <= other)")
    return (dealt.select("label", "size", "node", "members", "vector",
                         F.when(first, F.col("cell")).otherwise(F.col("near")).alias("one"),
                         F.when(first, F.col("near")).otherwise(F.col("cell")).alias("two"),
                         F.when(first, F.col("part")).otherwise(F.col("other")).alias("i"),
                         F.when(first, F.col("other")).otherwise(F.col("part")).alias("j"),
                         first.alias("left")))


def _compared(tiles: DataFrame, axes: dict[int, np.ndarray], tiling: Tiling) -> DataFrame:
    """(node, links, top) of the nodes with a link in a tile: linked rows counted, and a node that links join it to."""

    def compare(tile: pa.Table) -> pa.Table:
        size = tile.column("size")[0].as_py() // 8
        node, members = tile.column("node").to_numpy(), tile.column("members").to_numpy()
        x = np.frombuffer(b"".join(tile.column("vector").to_pylist()), np.float64).reshape(-1, size)
        left = tile.column("left").to_numpy(zero_copy_only=False)
        same = tile.column("one")[0] == tile.column("two")[0] and tile.column("i")[0] == tile.column("j")[0]
        a, b = (np.arange(len(node)),) * 2 if same else (np.flatnonzero(left), np.flatnonzero(~left))
        links, root = np.zeros(len(node), np.int64), list(range(len(node)))

        def top(k):
            while root[k] != k:
                root[k] = k = root[root[k]]
            return k

        if len(a) and len(b):
            i, j = similar(x[a], x[b], axes.get(size, np.eye(size)), tiling)
            i, j = a[i], b[j]
            if same:
                i, j = i[i < j], j[i < j]
            np.add.at(links, i, members[j])
            np.add.at(links, j, members[i])
            for p, q in zip(i.tolist(), j.tolist()):
                p, q = top(p), top(q)
                if p != q:
                    root[max(p, q)] = min(p, q)
        found = np.flatnonzero(links)
        return pa.table({"node": pa.array(node[found]), "links": pa.array(links[found]),
                         "top": pa.array(node[[top(k) for k in found]] if len(found) else node[:0])})

    return tiles.groupBy(*TILE).applyInArrow(compare, "node long, links long, top long")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                 tiling: Tiling = Tiling()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row.

    Rows link when their labels are equal and not null, their vectors have the same number of components and
    the cosine in double precision reaches ``tiling.cosine``. Equal vectors of a label are compared once, with
    their number. Only counts and one joining node per row leave a tile, never the pairs.

    A vector that is null, empty or zero, or that holds a null, NaN or infinite component, links with nothing.
    Repeated rows count as separate vectors. A row with a null id counts as a vector; a component is named by
    its smallest id that is not null. An empty table gives no row.
    """
    given = only(df, vec_id=df[id_col].cast("long"), label=df[label_col].cast("string"), vector=df[vector_col].cast("array<double>"))
    rows = stage(_rows(given), "vectors")
    nodes = stage(rows.where("digest IS NOT NULL").groupBy("label", "digest").agg(
        F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("members"), F.min("vector").alias("vector"))
        .withColumn("node", F.monotonically_increasing_id()), "vector-nodes")
    usual = nodes.groupBy((F.length("vector") / 8).cast("int").alias("size")).count().orderBy(F.desc("count"), "size").first()
    axes = {usual["size"]: principal_axes(nodes, usual["size"])} if usual else {}
    cells = stage(_cells(nodes, axes, tiling), "vector-cells")
    found = stage(_compared(_tiles(cells, tiling), axes, tiling), "vector-links")
    joined = components(found, "node", "top")
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    whole = (nodes.select("node", "label", "digest", "least", "members").join(counted, "node", "left").join(joined, "node", "left")
             .withColumn("component", F.coalesce("component", "node")))
    named = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    whole = whole.join(named, "component").select(
        "label", "digest", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("links"), "component_id")
    return (rows.select("vec_id", "label", "digest").join(whole, ["label", "digest"], "left")
            .select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))))
