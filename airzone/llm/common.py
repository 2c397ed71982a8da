"""Helpers the operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airzone.sources.tables import stage

#: White space that ends a word: \x20 and \x09-\x0D, which is what Java's \s and Python's bytes.split mean.
BLANKS = " \t\n\x0b\f\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """``df`` reduced to the named columns, so that a caller's extra columns cannot clash with ours."""
    return df.select(*[(df[c] if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def words(text: Column) -> Column:
    """Words of a text; null or blank text has none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"\s+"))


def leading_words(text: Column, n: Column) -> Column:
    """``text`` up to the end of its first ``n`` words, with the white space between them as it is."""
    parts = F.split(text, r"(?<=\s)(?=\S)")       # words with the white space after them
    leading = F.when(text.rlike(r"^\s"), 1).otherwise(0)
    return F.rtrim(F.array_join(F.slice(parts, F.lit(1), (n + leading).cast("int")), ""), F.lit(BLANKS))


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` reads it.

    Catalyst copies an expression into every place that names it, into lambdas too, where it would be computed
    again for every element.
    """
    return F.transform(F.array(value), use)[0]


def keyed_unit(*parts: Column | str) -> Column:
    """Leading 52 bits of a digest of ``parts`` as a long: a repeatable random number for sampling orders."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else p for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def components(edges: DataFrame, left: str = "a", right: str = "b", most: int = 60) -> DataFrame:
    """(node, component) of every node of an edge, the component named by its smallest node.

    Alternating large-star and small-star rounds: each takes every edge to the smallest neighbour of one of its
    ends, so a chain of n nodes needs about log n rounds. Edges stay distributed, hubs are pre-aggregated, and
    every round is a stored table. Null ends and loops are left out. No edge gives no row.
    """
    a, b = F.col(left), F.col(right)
    links = stage(edges.where(a != b).select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    seen = None
    for _ in range(most):
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
            links.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        low = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(low, "hi").select(F.explode(F.array(
            F.struct(F.col("hi"), F.col("m").alias("lo")),
            F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.hi", "e.lo")
        links = stage(small.where("hi != lo").distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components still changed after {most} rounds")
    return links.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("node"), "component").unionByName(
        links.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())


#: Rows of a key list that are still sent to every executor: two long columns of a million rows are 16 MB.
BROADCAST_ROWS = 1_000_000


def picked(rows: DataFrame, keys: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with a list of keys, which is broadcast if its row count, read here, is small enough.

    Wide rows such as texts then stay where they are; beyond the bound both sides are shuffled as usual.
    """
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, how)


def sliced(batch: pa.RecordBatch, column: str, held: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of a batch with their texts, about ``held`` characters at a time but one row at least; null is empty text."""
    ends = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(batch):
        base = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, base + held, "right")), at + 1)
        part = batch.slice(at, to - at)
        yield part, [t or "" for t in part.column(column).to_pylist()]
        at = to
