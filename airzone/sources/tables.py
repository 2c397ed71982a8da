"""Stored tables: full refreshes for users and stages shared inside one analysis."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import cache
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession


@cache
def _own_dir(application_id: str) -> str:
    return tempfile.mkdtemp(prefix="airzone-")


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a single-machine session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    return _own_dir(spark.sparkContext.applicationId)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/airzone/{spark.sparkContext.applicationId}/{name}-{uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and return the stored table.

    Later steps share the result instead of recomputing it, survive the loss of
    executors, and Catalyst knows its true size when it chooses joins.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (),
                sort_by: Sequence[str] = ()) -> None:
    """Full refresh of a Parquet table, laid out for pruning.

    ``df`` is evaluated once: the range bounds are sampled from a stored copy.

    Rows are range-partitioned on partition and sort columns together, so a file
    covers a narrow key range, a hot key spreads over several files, and no
    partition folder is fed by every task.
    """
    laid_out(df, [*partition_by, *sort_by]).write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def laid_out(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``df`` stored once and range-partitioned by ``order``; as it is without one."""
    return stage(df, "layout").repartitionByRange(*order).sortWithinPartitions(*order) if order else df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_table(df: DataFrame, path: str, *, partition_by: Sequence[str] = (), sort_by: Sequence[str] = ()) -> None:
    """Add rows to a Parquet table with the layout of ``write_table``."""
    laid_out(df, [*partition_by, *sort_by]).write.mode("append").partitionBy(*partition_by).parquet(path)


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The table at ``path``, or None before its first load."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
