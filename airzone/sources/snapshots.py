"""Stored tables that change as a whole: versioned folders, and a manifest that names those in use.

A write puts its rows into a folder of its own below ``data`` and then appends one file to ``manifest``, which lists
the folders of every partition. Readers follow the last entry, so they see the table before a write or after it, and
a job that is killed half-way leaves only a folder that no entry names. Entries keep the folders of partitions that
a write did not touch, so these are neither read nor copied. A table has one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegralType, StructType

from airzone.operators.keys import enrich
from airzone.sources.tables import laid_out, read_if_there, stage

#: Column that tells the folders of the writes apart; no table shows it.
TOKEN = "snapshot_"
ENTRY = "seq long, entry string, written_schema string, partition_by string, folders array<struct<value: string, token: string>>"


@dataclass(frozen=True)
class Version:
    """One entry of the manifest; ``folders`` are (partition value as text, token) pairs, the value None without partitions."""

    seq: int
    entry: str
    schema: StructType
    partition_by: str | None
    folders: tuple[tuple[str | None, str], ...]


def current(spark: SparkSession, root: str) -> Version | None:
    """The version in use, or None before the first write. Only the last entry is read to the driver, one pair per folder."""
    entries = read_if_there(spark, f"{root}/manifest", ENTRY)
    last = entries.orderBy(F.desc("seq"), "entry").limit(1).collect() if entries is not None else []
    if not last:
        return None
    row = last[0]
    return Version(row["seq"], row["entry"], StructType.fromJson(json.loads(row["written_schema"])), row["partition_by"],
                   tuple((f["value"], f["token"]) for f in row["folders"]))


def read(spark: SparkSession, root: str) -> DataFrame:
    """The table as its last finished write left it; an error before the first."""
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"no snapshot at {root}")
    if not version.folders:
        return spark.createDataFrame([], version.schema)
    stored = (spark.read.schema(StructType([*version.schema.fields, *StructType().add(TOKEN, "string").fields]))
              .option("basePath", f"{root}/data").parquet(*[_folder(root, version.partition_by, *f) for f in version.folders]))
    return stored.select(*version.schema.names)


def _folder(root: str, by: str | None, value: str | None, token: str) -> str:
    return f"{root}/data/{TOKEN}={token}" + (f"/{by}={value}" if by else "")


def replace_table(df: DataFrame, root: str, *, partition_by: str | None = None, sort_by: Sequence[str] = ()) -> DataFrame:
    """Full refresh: the new rows are the table. Returns the stored table.

    ``partition_by`` names a column of whole numbers; its NULLs make a partition of their own. Rows are laid out as
    by ``tables.write_table``.
    """
    before = current(df.sparkSession, root)
    return _publish(df, root, before, df.schema, partition_by, [], sort_by)


def append(df: DataFrame, root: str, *, partition_by: str | None = None, sort_by: Sequence[str] = ()) -> DataFrame:
    """Add rows; no stored file is read or written again. ``partition_by`` counts for the first write only."""
    before = current(df.sparkSession, root)
    if before is None:
        return replace_table(df, root, partition_by=partition_by, sort_by=sort_by)
    return _publish(df, root, before, _widened(before.schema, df.schema), before.partition_by, before.folders, sort_by)


def replace_partitions(df: DataFrame, root: str, values: Iterable[int | None], *, sort_by: Sequence[str] = ()) -> DataFrame:
    """Rows of the partitions ``values`` become those of ``df``, which must have no other; a partition without rows goes.

    All other partitions keep their files. Columns that the table lacks are added and read as NULL elsewhere.
    """
    before = current(df.sparkSession, root)
    if before is None or before.partition_by is None:
        raise ValueError(f"{root} is not a partitioned snapshot")
    touched = {_name(v) for v in values}
    kept = [f for f in before.folders if f[0] not in touched]
    return _publish(df, root, before, _widened(before.schema, df.schema), before.partition_by, kept, sort_by, touched)


def update_rows(computed: DataFrame, root: str, keys: Sequence[str], *, sort_by: Sequence[str] = ()) -> DataFrame:
    """Write the columns of ``computed`` (one row per key) over the stored rows of these keys, as ``enrich`` does.

    Only partitions that hold such a key are read whole and written anew; a table without partitions is one.
    Keys that the table lacks change nothing. New columns are NULL in rows that are not named.
    """
    spark = computed.sparkSession
    before = current(spark, root)
    if before is None:
        raise ValueError(f"no snapshot at {root}")
    stored, new = read(spark, root), stage(computed, "update")
    if before.partition_by is None:
        return replace_table(enrich(stored, new, keys), root, sort_by=sort_by)
    if before.partition_by in new.columns and before.partition_by not in keys:
        raise ValueError("the partition column cannot be updated")
    held = stored.join(new.select(*keys), list(keys), "left_semi").select(before.partition_by).distinct().collect()
    values = [r[0] for r in held]      # partitions, not rows
    return replace_partitions(enrich(_within(stored, before.partition_by, values), new, keys), root, values, sort_by=sort_by)


def _within(df: DataFrame, column: str, values: Iterable[int | None]) -> DataFrame:
    """Rows of some partitions, by a filter that prunes folders."""
    some = F.col(column).isin([v for v in values if v is not None])
    return df.filter(some | F.col(column).isNull() if None in values else some)


def unused(spark: SparkSession, root: str) -> DataFrame:
    """(folder) of earlier versions that the present one does not name; they may go once no reader is left on them."""
    version = current(spark, root)
    entries = read_if_there(spark, f"{root}/manifest", ENTRY)
    if version is None or entries is None:
        return spark.createDataFrame([], "folder string")
    named = entries.select("partition_by", F.explode("folders").alias("f")).select("partition_by", "f.value", "f.token").distinct()
    used = spark.createDataFrame([(t, v) for v, t in version.folders], "token string, value string")
    left = named.join(used, named["token"].eqNullSafe(used["token"]) & named["value"].eqNullSafe(used["value"]), "left_anti")
    below = F.when(F.col("partition_by").isNotNull(), F.concat(F.lit("/"), "partition_by", F.lit("="), "value"))
    return left.select(F.concat(F.lit(f"{root}/data/{TOKEN}="), "token", F.coalesce(below, F.lit(""))).alias("folder"))


def _name(value: int | None) -> str:
    return "__HIVE_DEFAULT_PARTITION__" if value is None else str(value)


def _widened(old: StructType, new: StructType) -> StructType:
    """Columns of the table, then those it lacks; a column of another type is an error."""
    types = {f.name: f.dataType for f in old.fields}
    wrong = [f.name for f in new.fields if f.name in types and types[f.name] != f.dataType]
    if wrong:
        raise ValueError(f"columns of another type than stored: {wrong}")
    return StructType([*old.fields, *[f for f in new.fields if f.name not in types]])


def _publish(df: DataFrame, root: str, before: Version | None, schema: StructType, by: str | None,
             kept: Sequence[tuple], sort_by: Sequence[str], allowed: set[str] | None = None) -> DataFrame:
    """Write ``df`` into a folder of its own, then the entry that names it beside the ``kept`` folders."""
    spark, token = df.sparkSession, f"v{uuid4().hex[:16]}"
    if TOKEN in df.columns or by and not isinstance(schema[by].dataType, IntegralType):
        raise ValueError(f"{TOKEN} must not be a column, and partitions need whole numbers")
    rows = laid_out(df, [*([by] if by else []), *sort_by])
    target = f"{root}/data/{TOKEN}={token}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(target)
    values = [_name(r[0]) for r in spark.read.schema(schema).parquet(target).select(by).distinct().collect()] if by else [None]
    if allowed is not None and not allowed.issuperset(values):
        raise ValueError(f"rows of partitions that are not replaced: {sorted(set(values) - allowed)}")
    folders = [*kept, *[(v, token) for v in values]]
    entry = (before.seq + 1 if before else 0, uuid4().hex, schema.json(), by, folders)
    spark.createDataFrame([entry], ENTRY).coalesce(1).write.mode("append").parquet(f"{root}/manifest")
    now = current(spark, root)
    if now.entry != entry[1]:
        raise RuntimeError(f"another writer changed {root} at the same time; this write is not in use")
    return read(spark, root)
