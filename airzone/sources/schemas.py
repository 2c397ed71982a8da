"""Declared schemas of the input tables; nothing is inferred."""

from pyspark.sql.types import (DateType, DecimalType, DoubleType, IntegerType, StringType,
                               StructField, StructType, TimestampNTZType)


def _schema(*fields: tuple) -> StructType:
    return StructType([StructField(name, kind, nullable) for name, kind, nullable in fields])


SITES = _schema(
    ("site_id", StringType(), False), ("site_name", StringType(), True),
    ("site_type", StringType(), True), ("caz_zone", StringType(), True),
    ("latitude", DoubleType(), True), ("longitude", DoubleType(), True),
    ("data_source", StringType(), True), ("start_date", DateType(), True),
    ("end_date", DateType(), True))

READINGS_STAGING = _schema(
    ("site_id", StringType(), True), ("date_time", StringType(), True), ("no2", DoubleType(), True))

READINGS = _schema(
    ("site_id", StringType(), False), ("date_time", TimestampNTZType(), False), ("no2", DoubleType(), True))

TRAFFIC = _schema(
    ("date", DateType(), False), ("vehicle_type", StringType(), False),
    ("compliant_vehicles", IntegerType(), True), ("noncompliant_vehicles", IntegerType(), True),
    ("total_vehicles", IntegerType(), False))

WARDS = _schema(
    ("area_code", StringType(), False), ("area_name", StringType(), False),
    ("latitude", DoubleType(), False), ("longitude", DoubleType(), False))

ADMISSIONS = _schema(
    ("health_condition", StringType(), False), ("area_code", StringType(), False),
    ("fiscal_start_date", DateType(), False), ("admissions", IntegerType(), False),
    ("population", IntegerType(), False), ("standardised_rate", DecimalType(6, 2), False))

WARD_BOUNDARIES = _schema(
    ("fid", IntegerType(), True), ("wd23cd", StringType(), True), ("wd23nm", StringType(), False),
    ("wd23nmw", StringType(), True), ("lad23cd", StringType(), True), ("lad23nm", StringType(), True),
    ("wkt", StringType(), False))

ZONES = _schema(("name", StringType(), False), ("wkt", StringType(), False))

TIERS = _schema(
    ("caz_tier", StringType(), False), ("tier_description", StringType(), True), ("wkt", StringType(), True))

# Declared keys of the tables above.
KEYS = {
    "sites": ["site_id"],
    "readings": ["site_id", "date_time"],
    "traffic": ["date", "vehicle_type"],
    "wards": ["area_code"],
    "admissions": ["health_condition", "area_code", "fiscal_start_date"],
    "ward_boundaries": ["wd23nm"],
    "tiers": ["caz_tier"],
    "years": ["calendar_year"],
    "years (fiscal)": ["fiscal_year"],
    "yearly_traffic_summary": ["year", "vehicle_type"],
}
