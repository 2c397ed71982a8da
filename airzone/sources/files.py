"""CSV loads with declared schemas, and the staging-to-fact step for readings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from airzone import constants as C
from airzone.functions.calendar import fiscal_label, parse_timestamp
from airzone.operators.keys import unknown_rows
from airzone.sources import schemas
from airzone.sources.tables import append_table, read_if_there


def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType, **options) -> DataFrame:
    """One or many header CSV files or folders as one table; a malformed row stops the load."""
    return (spark.read.schema(schema)
            .options(header=True, mode="FAILFAST", **options)
            .csv(paths if isinstance(paths, str) else list(paths)))


def split_staging(staging: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text timestamps parsed: (readings, rows whose text is not a timestamp).

    A row explodes into its one parsed timestamp or into nothing, so each text
    is parsed once; a filter would parse it again ahead of the projection.
    """
    parsed = F.array_compact(F.array(parse_timestamp(F.col("date_time"))))
    readings = staging.select("site_id", F.explode(parsed).alias("date_time"), "no2")
    return readings, staging.filter(parse_timestamp(F.col("date_time")).isNull())


def load_staged_readings(staging: DataFrame, target: DataFrame | None = None, *,
                         floor: float = C.SENTINEL_FLOOR, rejects: str = "fail") -> DataFrame:
    """New readings from raw text rows: parsed, one per (site, hour), unknown to ``target``.

    Of several rows of one hour a valid reading (``floor`` or more) wins over instrument errors, the
    smallest of equals. A text that is no timestamp stops the load; with ``rejects="skip"`` the caller takes
    such rows from ``split_staging`` and their number from ``load_report``.
    """
    if rejects not in ("fail", "skip"):
        raise ValueError("rejects must be 'fail' or 'skip'")
    if rejects == "skip":
        readings, _ = split_staging(staging)
    else:
        parsed = parse_timestamp(F.col("date_time"))
        wrong = F.raise_error(F.concat(F.lit("not a timestamp: "), F.coalesce("date_time", F.lit("NULL"))))
        readings = staging.select("site_id", F.coalesce(parsed, wrong.cast("timestamp_ntz")).alias("date_time"), "no2")
    return unknown_rows(one_per_hour(readings, floor), target, schemas.KEYS["readings"])


def one_per_hour(readings: DataFrame, floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """A valid reading wins, the smallest of equals. Two partial minima per map task decide, so repeats are dropped before the shuffle."""
    best = F.coalesce(F.min(F.when(F.col("no2") >= floor, F.col("no2"))), F.min("no2"))
    return readings.groupBy(*schemas.KEYS["readings"]).agg(best.alias("no2"))


def load_report(staging: DataFrame, target: DataFrame | None = None) -> DataFrame:
    """One row: rows read, rejected (no timestamp), duplicate, known to ``target`` and kept; the last four add up to the first."""
    keys = schemas.KEYS["readings"]
    hours = (staging.withColumn("date_time", parse_timestamp(F.col("date_time")))
             .groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))
    known = F.lit(False)
    if target is not None:
        hours = hours.join(target.select(*keys).distinct().withColumn("known", F.lit(True)), list(keys), "left")
        known = F.coalesce("known", F.lit(False))
    bad = F.col("date_time").isNull()
    total = lambda value: F.coalesce(F.sum(value), F.lit(0)).alias
    return hours.agg(total(F.col("n"))("rows_read"), total(F.when(bad, F.col("n")))("rejected"),
                     total(F.when(~bad, F.col("n") - 1))("duplicates"), total(F.when(~bad & known, 1))("known"),
                     total(F.when(~bad & ~known, 1))("kept"))


def append_readings(staging: DataFrame, path: str, **options) -> None:
    """Load ``staging`` into the stored fact at ``path``, partitioned by year; a second load of the same rows adds none.

    Only the years of the batch are compared and written.
    """
    spark = staging.sparkSession
    stored = read_if_there(spark, path, "site_id {}, date_time timestamp_ntz, no2 double, year int".format(
        staging.schema["site_id"].dataType.simpleString()))
    new = load_staged_readings(staging, stored, **options)
    append_table(new.withColumn("year", F.year("date_time")), path, partition_by=["year"], sort_by=["site_id", "date_time"])


def with_fiscal_year(admissions: DataFrame) -> DataFrame:
    """Add the generated ``fiscal_year`` of each period's start date."""
    return admissions.withColumn("fiscal_year", fiscal_label(F.year("fiscal_start_date")))
