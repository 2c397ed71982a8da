"""Loads that keep what they cannot use, and that count while they load."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructType

from airzone import constants as C
from airzone.functions.calendar import parse_timestamp
from airzone.operators.keys import unknown_rows
from airzone.sources import schemas, snapshots
from airzone.sources.files import one_per_hour
from airzone.sources.tables import stage

CORRUPT = "_corrupt_record"


def read_csv_checked(spark: SparkSession, paths: str | Sequence[str], schema: StructType, **options) -> tuple[DataFrame, DataFrame]:
    """(rows that fit ``schema``, rejects as file, text and reason) of header CSV files, which are read once.

    A row with too few or too many fields, or with a field that is no value of its column's type, is rejected with its
    whole text; every other row is in the first table. The reason names the first such column, else the number of fields.
    """
    checked = stage(_checked(spark, paths, schema, **options), "checked")
    return (checked.filter(F.col("reason").isNull()).select(*schema.names),
            checked.filter(F.col("reason").isNotNull()).select("file", F.col(CORRUPT).alias("text"), "reason"))


def _checked(spark: SparkSession, paths: str | Sequence[str], schema: StructType, **options) -> DataFrame:
    """Every row with its file, its text if it does not fit, and the reason why."""
    given = (spark.read.schema(StructType([*schema.fields, *StructType().add(CORRUPT, StringType()).fields]))
             .options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning=False, **options)
             .csv(paths if isinstance(paths, str) else list(paths)))
    return given.select(*schema.names, CORRUPT, F.col("_metadata.file_path").alias("file"), _reason(schema, options).alias("reason"))


def _reason(schema: StructType, options: dict) -> Column:
    texts = ", ".join(f"`{n}` STRING" for n in schema.names)
    fields = F.from_csv(CORRUPT, texts, {"mode": "PERMISSIVE", **{k: str(v) for k, v in options.items()}})
    wrong = [F.when(fields[f.name].isNotNull() & F.col(f"`{f.name}`").isNull() & fields[f.name].try_cast(f.dataType).isNull(),
                    F.lit(f"{f.name}: not of type {f.dataType.simpleString()}"))
             for f in schema.fields if not isinstance(f.dataType, StringType)]
    return F.when(F.col(CORRUPT).isNotNull(), F.coalesce(*wrong, F.lit("wrong number of fields")))


@dataclass(frozen=True)
class Load:
    """What one load did: its counts, and the stored tables after it."""

    counts: dict
    readings: DataFrame
    rejects: DataFrame


COUNTS = ("rows_read long, rejected long, duplicates long, known long, kept long, null_no2 long, sentinel_no2 long, "
          "first_hour timestamp_ntz, last_hour timestamp_ntz")


def load_readings(spark: SparkSession, paths: str | Sequence[str], folder: str, rejects: str, *, floor: float = C.SENTINEL_FLOOR) -> Load:
    """Text rows of CSV files into the stored fact at ``folder``, by year; what cannot be used goes to the table ``rejects``.

    Rows whose fields or timestamps are wrong are stored with file, text and reason, those of one load under one ``batch`` number.
    Repeats of an hour and hours that the fact has are left out, as by ``load_staged_readings``. The counts are observed
    by the jobs that do the loading: the files are read once and no table is scanned for them. They are taken in the
    tasks that write, whose retries Spark does not count twice. rows_read = rejected + duplicates + known + kept.
    """
    read, hours, new = Observation("read"), Observation("hours"), Observation("new")
    at = parse_timestamp(F.col("date_time"))
    rows = _checked(spark, paths, schemas.READINGS_STAGING).select(
        "site_id", F.col("date_time").alias("given"), F.element_at(F.array(at), 1).alias("date_time"), "no2", CORRUPT, "file", "reason")
    late = F.when(F.col("date_time").isNull(), F.lit("date_time: not a timestamp"))
    judged = rows.withColumn("reason", F.coalesce("reason", late)).observe(
        read, F.count(F.lit(1)).alias("rows_read"), F.count("reason").alias("rejected"),
        F.count_if(F.col("reason").isNull() & F.col("no2").isNull()).alias("null_no2"),
        F.count_if(F.col("reason").isNull() & (F.col("no2") < floor)).alias("sentinel_no2"),
        F.min(F.when(F.col("reason").isNull(), F.col("date_time"))).alias("first_hour"),
        F.max(F.when(F.col("reason").isNull(), F.col("date_time"))).alias("last_hour"))
    stored = stage(judged, "load")
    distinct = stage(one_per_hour(stored.filter("reason IS NULL").select("site_id", "date_time", "no2"), floor)
                     .observe(hours, F.count(F.lit(1)).alias("n")), "load-hours")
    fact = snapshots.current(spark, folder)
    fresh = distinct if fact is None else unknown_rows(distinct, snapshots.read(spark, folder), schemas.KEYS["readings"])
    readings = snapshots.append(fresh.observe(new, F.count(F.lit(1)).alias("n")).withColumn("year", F.year("date_time")),
                                folder, partition_by="year", sort_by=["site_id", "date_time"])
    before = snapshots.current(spark, rejects)
    text = F.coalesce(CORRUPT, F.to_csv(F.struct("site_id", F.col("given").alias("date_time"), "no2")))
    bad = snapshots.append(stored.filter("reason IS NOT NULL").select(
        F.lit(before.seq + 1 if before else 0).cast("long").alias("batch"), "file", text.alias("text"), "reason"), rejects)
    seen, n, kept = read.get, hours.get["n"], new.get["n"]
    counts = {"rows_read": seen["rows_read"], "rejected": seen["rejected"], "duplicates": seen["rows_read"] - seen["rejected"] - n,
              "known": n - kept, "kept": kept, **{k: seen[k] for k in ("null_no2", "sentinel_no2", "first_hour", "last_hour")}}
    return Load(counts, readings, bad)
