"""Literal dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airzone import constants as C
from airzone.functions.calendar import fiscal_label
from airzone.sources import schemas


def zone(spark: SparkSession, name: str = C.ZONE_NAME, wkt: str = C.ZONE_WKT) -> DataFrame:
    return spark.createDataFrame([(name, wkt)], schemas.ZONES)


def tiers(spark: SparkSession, outlines: DataFrame | None = None) -> DataFrame:
    """The five tiers; ``outlines`` (caz_tier, wkt) supplies their polygons."""
    labels = spark.createDataFrame(list(C.TIER_DESCRIPTIONS), "caz_tier string, tier_description string")
    if outlines is None:
        return labels.withColumn("wkt", F.lit(None).cast("string"))
    return labels.join(outlines.select("caz_tier", "wkt"), "caz_tier", "left")


def years(spark: SparkSession, first: int = C.CALENDAR_YEARS[0], last: int = C.CALENDAR_YEARS[1]) -> DataFrame:
    """Calendar year to the fiscal year that starts in it."""
    span = spark.range(first, last + 1).select(F.col("id").cast("int").alias("calendar_year"))
    return span.withColumn("fiscal_year", fiscal_label(F.col("calendar_year")))


def years_of(df: DataFrame, day: Column) -> DataFrame:
    """The same bridge, covering every year between the first and last ``day`` of a table."""
    span = df.agg(F.year(F.min(day)).alias("lo"), F.year(F.max(day)).alias("hi"))
    return (span.select(F.explode(F.sequence("lo", "hi")).alias("calendar_year"))
            .withColumn("fiscal_year", fiscal_label(F.col("calendar_year"))))
