"""Keys: counting them and keeping one row of each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def rows_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("occurrences"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key, the first in ``order`` (default: every other column ascending, NULL last).

    Repeats of a key are dropped inside each map task, before the shuffle: by a
    partial minimum when one column decides, else by the ``rank = 1`` limit.
    """
    rest = [n for n in df.columns if n not in keys]
    if order is None and len(rest) == 1:
        return df.groupBy(*keys).agg(F.min(rest[0]).alias(rest[0])).select(*df.columns)
    order = order or [F.asc_nulls_last(n) for n in rest] or [F.col(keys[0])]
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def insert_ignore(new: DataFrame, target: DataFrame | None, keys: Sequence[str],
                  order: Sequence[Column] | None = None) -> DataFrame:
    """Rows of ``new`` to append to ``target``: known keys and repeats are skipped."""
    return unknown_rows(first_per_key(new, keys, order), target, keys)


def unknown_rows(fresh: DataFrame, target: DataFrame | None, keys: Sequence[str]) -> DataFrame:
    """Rows of ``fresh`` whose key ``target`` lacks.

    A target with ``date_time`` in its key is first cut down to the times of the batch, and one partitioned by
    ``year`` to its years, so the history is not read; the two bounds are the only values the driver reads.
    """
    if target is None:
        return fresh
    if "date_time" in keys:
        low, high = fresh.agg(F.min("date_time"), F.max("date_time")).first()
        if low is not None:
            target = target.filter(F.col("date_time").between(F.lit(low), F.lit(high)))
            if "year" in target.columns:
                target = target.filter(F.col("year").between(low.year, high.year))
    return fresh.join(target.select(*keys), list(keys), "left_anti")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
          rank_name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group, ranked from 1.

    Each map task keeps its own best ``n`` per group, so even a group with most
    of the rows sends at most ``n`` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank_name, rank).filter(F.col(rank_name) <= n)


def enrich(dim: DataFrame, computed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dim`` with the columns of ``computed`` written over it by key.

    Matched rows take the computed values, NULLs included; the others keep what
    they had. ``computed`` must have one row per key.
    """
    new = [n for n in computed.columns if n not in keys]
    incoming = computed.select(*keys, F.struct(*new).alias("_new"))
    joined = dim.join(incoming, list(keys), "left")

    def value(name: str) -> Column:
        if name not in new:
            return F.col(name)
        old = F.col(name) if name in dim.columns else F.lit(None)
        return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(old).alias(name)

    added = [n for n in new if n not in dim.columns]
    return joined.select(*[value(n) for n in [*dim.columns, *added]])
