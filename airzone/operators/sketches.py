"""Approximate quantiles from mergeable sketches (KLL), one per group of a fine grain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

#: Size parameter of a sketch: some tens of kilobytes at most, whatever the group holds.
K = 4096


def rank_error(k: int = K) -> float:
    """Share of a group's rows by which a quantile's rank may be off, with 99 % confidence (published fit for KLL)."""
    return 2.296 / k ** 0.9723


def sketched(df: DataFrame, keys: Sequence[str], value: str, *, k: int = K) -> DataFrame:
    """``keys``, ``sketch`` and ``n`` of every group; NULL and NaN values are left out, groups without others too."""
    known = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), k).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The sketches of finer groups, or of separate batches, merged to those of ``keys``."""
    return sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, keys: Sequence[str], wanted: Mapping[str, float]) -> DataFrame:
    """One column per name in ``wanted``, a value of the group whose rank is near the quantile, and ``n``."""
    return sketches.select(*keys, *[F.kll_sketch_get_quantile_double("sketch", F.lit(q)).alias(name) for name, q in wanted.items()], "n")
