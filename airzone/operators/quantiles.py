"""Exact interpolated quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from airzone.sources.tables import stage

# Buckets per e-fold at each level, as powers of two. All doubles together fall
# into under 400,000 buckets of the first level, each of which the second splits
# into 2**20: both histograms are bounded, and values finally sorted side by
# side agree to 28 bits.
BUCKET_BITS = (8, 28)


def _bucket(value: Column, bits: int) -> Column:
    """Order-keeping bucket: linear near zero, logarithmic away from it. Never NULL."""
    scaled = F.signum(value) * F.log1p(F.abs(value)) * float(2**bits)
    bucket = F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(F.floor(scaled))
    return F.coalesce(bucket, F.lit(0))


def grouped_quantiles(df: DataFrame, keys: Sequence[str], value: str, quantiles: Mapping[str, float]) -> DataFrame:
    """``PERCENTILE_CONT`` of ``value`` per group, one column for each name in ``quantiles``.

    A group is never gathered in one task. A first pass counts rows per (group,
    bucket), mostly inside the map tasks, and stores the few buckets that hold
    the wanted ranks. A second pass keeps only the values of those buckets, by a
    semi join with the stored list. Catalyst knows its size: a short list goes to
    the rows ahead of the count, a long one meets the counted values. What is left
    goes to a finer histogram and then to a sort.
    NULL is a key like any other; rows with a NULL value are ignored.
    """
    # as one struct, keys with NULL in them meet in joins too
    values = df.filter(F.col(value).isNotNull()).select(F.struct(*keys).alias("_k"), F.col(value).cast("double").alias("_v"))
    named, keys = list(keys), ["_k"]

    def position(q: float) -> Column:
        return (F.col("_n") - 1) * F.lit(q)

    def holds(rank: Column, size: str) -> Column:
        """Ranks count from 0; ``_last`` rows of the group end with this one."""
        return (F.col("_last") > rank) & (F.col("_last") - F.col(size) <= rank)

    wanted = [rank(position(q)) for q in quantiles.values() for rank in (F.floor, F.ceil)]

    def up_to_here(group: list[str], order: str, size: str) -> Column:
        return F.sum(size).over(
            Window.partitionBy(*group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))

    def wanted_buckets(histogram: DataFrame, bucket: list[str]) -> DataFrame:
        holding = histogram.filter(reduce(Column.__or__, [holds(r, "_size") for r in wanted]))
        return holding.select(*bucket, (F.col("_last") - F.col("_size")).alias("_before"), "_n")

    coarse, fine = [*keys, "_b0"], [*keys, "_b0", "_b1"]
    first = (values.groupBy(*keys, _bucket(F.col("_v"), BUCKET_BITS[0]).alias("_b0"))
             .agg(F.count(F.lit(1)).alias("_size"))
             .withColumns({"_last": up_to_here(list(keys), "_b0", "_size"),
                           "_n": F.sum("_size").over(Window.partitionBy(*keys))}))
    picked = stage(wanted_buckets(first, coarse), "quantile_buckets")
    counts = (values.groupBy(*keys, _bucket(F.col("_v"), BUCKET_BITS[0]).alias("_b0"), "_v").agg(F.count(F.lit(1)).alias("_c"))
              .join(picked.select(*coarse), coarse, "left_semi"))

    split = counts.withColumn("_b1", _bucket(F.col("_v"), BUCKET_BITS[1]))
    second = (split.groupBy(*fine).agg(F.sum("_c").alias("_size")).join(picked, coarse)
              .withColumn("_last", F.col("_before") + up_to_here(coarse, "_b1", "_size")))
    ranked = (split.join(wanted_buckets(second, fine), fine)
              .withColumn("_last", F.col("_before") + up_to_here(fine, "_v", "_c")))

    def at(rank: Column) -> Column:
        return F.max(F.when(holds(rank, "_c"), F.col("_v")))

    ends = ranked.groupBy(*keys).agg(F.max("_n").alias("_n"), *[
        c for i, q in enumerate(quantiles.values())
        for c in (at(F.floor(position(q))).alias(f"_lo{i}"), at(F.ceil(position(q))).alias(f"_hi{i}"))])
    def between(i: int, q: float) -> Column:
        low, high, at_rank = F.col(f"_lo{i}"), F.col(f"_hi{i}"), position(q)
        return F.when(low == high, low).otherwise(low + (high - low) * (at_rank - F.floor(at_rank)))

    return ends.select(*[F.col("_k")[n].alias(n) for n in named], *[between(i, q).alias(name) for i, (name, q) in enumerate(quantiles.items())])
