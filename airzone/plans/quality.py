"""Quality reports on sites, readings, traffic, wards and admissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airzone import constants as C
from airzone.functions.labels import expectation, out_of_bounds_reason
from airzone.functions.numeric import outside, percent, round_half_up
from airzone.operators.audits import null_counts
from airzone.operators.quantiles import grouped_quantiles


def _rows() -> Column:
    return F.count(F.lit(1))


# ---- sites ---------------------------------------------------------------

def duplicate_names(sites: DataFrame) -> DataFrame:
    """Site names used by more than one row, with the ids behind them."""
    return (sites.groupBy("site_name")
            .agg(F.countDistinct("site_id").alias("distinct_site_ids"), _rows().alias("total_occurrences"))
            .filter(F.col("total_occurrences") > 1))


def bbox_violations(sites: DataFrame, *, latitude_bounds=C.LATITUDE_BOUNDS,
                    longitude_bounds=C.LONGITUDE_BOUNDS) -> DataFrame:
    """Places outside the bounding box and the first rule they fail."""
    reason = out_of_bounds_reason(F.col("latitude"), F.col("longitude"),
                                  latitude_bounds=latitude_bounds, longitude_bounds=longitude_bounds)
    return (sites.select("site_id", "site_name", "latitude", "longitude", reason.alias("spatial_flag"))
            .filter(F.col("spatial_flag").isNotNull()))


def date_bounds(sites: DataFrame) -> DataFrame:
    """First and last start and end dates; ends before starts should be 0."""
    return sites.agg(
        F.min("start_date").alias("earliest_site_start"), F.max("start_date").alias("latest_site_start"),
        F.min("end_date").alias("earliest_site_end"), F.max("end_date").alias("latest_site_end"),
        F.count_if(F.col("end_date") < F.col("start_date")).alias("invalid_date_logic_count"))


def decommissioned_sites(sites: DataFrame) -> DataFrame:
    return (sites.filter(F.col("end_date").isNotNull())
            .select("site_id", "site_name", "site_type", "caz_zone", "start_date", "end_date"))


# ---- readings ------------------------------------------------------------

def readings_cleaned(readings: DataFrame, floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """Every reading, with instrument error codes replaced by NULL."""
    valid = F.when(F.col("no2") < floor, None).otherwise(F.col("no2"))
    return readings.withColumn("no2_diagnosed", valid)


def completeness_readings(readings: DataFrame) -> DataFrame:
    return null_counts(readings, ["site_id", "date_time", "no2"]).withColumn(
        "no2_nulls_percentage", percent(F.col("no2_nulls"), F.col("total_records")))


def reading_horizon(readings: DataFrame, as_of: Column | None = None) -> DataFrame:
    """First and last reading, and readings later than ``as_of`` (default now)."""
    as_of = F.current_timestamp() if as_of is None else as_of
    return readings.agg(
        F.min("date_time").alias("earliest_reading"), F.max("date_time").alias("latest_reading"),
        F.count_if(F.col("date_time") > as_of).alias("future_readings_count"))


def site_distribution(readings: DataFrame, sites: DataFrame, spike: float = C.SPIKE_LIMIT) -> DataFrame:
    """Per site: count, range, mean, median and implausible values."""
    no2 = F.col("no2")
    summary = readings.groupBy("site_id").agg(
        _rows().alias("total_readings"), F.min(no2).alias("min_no2"), F.max(no2).alias("max_no2"),
        round_half_up(F.avg(no2), 2).alias("avg_no2"),
        F.count_if(no2 < 0).alias("negative_values"), F.count_if(no2 == 0).alias("zero_values"),
        F.count_if(no2 > spike).alias("extreme_spikes"))
    medians = grouped_quantiles(readings, ["site_id"], "no2", {"median_no2": 0.5})
    return (summary.join(sites.select("site_id", "site_name"), "site_id")
            .join(medians, "site_id", "left")
            .select("site_id", "site_name", "total_readings", "min_no2", "max_no2", "avg_no2",
                    "median_no2", "negative_values", "zero_values", "extreme_spikes"))


def negative_severity(readings: DataFrame, sites: DataFrame, floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """Per site: slight drift (``floor`` to 0, zeros included) against severe errors."""
    no2 = F.col("no2")
    drift, severe, rows = F.col("minor_drift_count"), F.col("severe_anomaly_count"), F.col("total_site_readings")
    summary = readings.groupBy("site_id").agg(
        _rows().alias("total_site_readings"),
        F.count_if(no2 < 0).alias("total_negative_readings"),
        F.count_if(no2.between(floor, 0)).alias("minor_drift_count"),
        F.count_if(no2 < floor).alias("severe_anomaly_count"),
        F.min(no2).alias("worst_negative_reading"))
    return (summary.join(sites.select("site_id", "site_name"), "site_id")
            .select("site_id", "site_name", rows, "total_negative_readings",
                    drift, percent(drift, rows, 4).alias("minor_drift_pct_of_site_total"),
                    severe, percent(severe, rows, 4).alias("severe_anomaly_pct_of_site_total"),
                    "worst_negative_reading"))


# ---- traffic -------------------------------------------------------------

MEASURES = {"compliant": "compliant_vehicles", "noncompliant": "noncompliant_vehicles",
            "total": "total_vehicles"}


def traffic_quality(traffic: DataFrame) -> DataFrame:
    """NULLs, negatives and zeros of each measure, and the number of vehicle types."""
    missing = F.count_if(F.col("compliant_vehicles").isNull())
    return traffic.agg(
        _rows().alias("total_rows"), missing.alias("compliance_nulls"),
        percent(missing, _rows()).alias("compliance_nulls_pct"),
        *[F.count_if(F.col(c) < 0).alias(f"negative_{n}_count") for n, c in MEASURES.items()],
        *[F.count_if(F.col(c) == 0).alias(f"zero_{n}_count") for n, c in MEASURES.items()],
        F.countDistinct("vehicle_type").alias("distinct_vehicle_types"))


def traffic_stats(traffic: DataFrame) -> DataFrame:
    """Per vehicle type: range, mean and median of each measure and of the compliance rate."""
    rate = F.try_divide(F.col("compliant_vehicles") * 100.0, F.col("total_vehicles"))
    measured = traffic.withColumn("_rate", rate)
    summary = measured.groupBy("vehicle_type").agg(
        *[a for n, c in MEASURES.items() for a in (
            F.min(c).alias(f"min_{n}"), F.max(c).alias(f"max_{n}"),
            round_half_up(F.avg(c), 1).alias(f"avg_{n}"))],
        *[round_half_up(f("_rate"), 2).alias(f"{n}_compliance_rate_pct")
          for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg))])

    # One pass finds the medians of all four measures.
    long = measured.select("vehicle_type", F.explode(F.array(*[
        F.struct(F.lit(n).alias("m"), F.col(c).cast("double").alias("v"))
        for n, c in {**MEASURES, "rate": "_rate"}.items()])).alias("_s")).select("vehicle_type", "_s.*")
    medians = grouped_quantiles(long, ["vehicle_type", "m"], "v", {"q": 0.5})
    wide = medians.groupBy("vehicle_type").agg(
        *[F.max(F.when(F.col("m") == n, F.col("q"))).alias(f"median_{n}") for n in MEASURES],
        round_half_up(F.max(F.when(F.col("m") == "rate", F.col("q"))), 2).alias("median_compliance_rate_pct"))
    return summary.join(wide, "vehicle_type", "left")


def traffic_coverage(traffic: DataFrame) -> DataFrame:
    return traffic.groupBy("vehicle_type").agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"),
        F.countDistinct("date").alias("unique_months"))


# ---- wards and admissions ------------------------------------------------

def ward_count_check(wards: DataFrame, expected: int = C.EXPECTED_WARDS) -> DataFrame:
    rows, codes = _rows(), F.countDistinct("area_code")
    return wards.agg(rows.alias("total_wards_logged"), codes.alias("unique_area_codes")).withColumn(
        "count_check", expectation(
            (F.col("total_wards_logged") == expected) & (F.col("unique_area_codes") == expected),
            f"PASS: All {expected} Unique Wards Accounted For",
            "FAIL: Incorrect Ward Count or Duplicate Area Codes"))


def ward_name_check(wards: DataFrame) -> DataFrame:
    """Names must be unique and free of outer blanks."""
    name = F.col("area_name")
    return wards.agg(
        F.count(name).alias("total_names"), F.countDistinct(name).alias("unique_names"),
        F.count_if(name != F.trim(name)).alias("names_with_whitespace"),
    ).withColumn("name_integrity_check", expectation(
        (F.col("total_names") == F.col("unique_names")) & (F.col("names_with_whitespace") == 0),
        "PASS: All Names Unique & Clean", "FAIL: Duplicate Names or Whitespace Detected"))


def ward_bounds(wards: DataFrame, *, latitude_bounds=C.LATITUDE_BOUNDS,
                longitude_bounds=C.LONGITUDE_BOUNDS) -> DataFrame:
    lat, lon = F.col("latitude"), F.col("longitude")
    return wards.agg(
        F.min(lat).alias("min_lat"), F.max(lat).alias("max_lat"),
        F.min(lon).alias("min_lon"), F.max(lon).alias("max_lon"),
        F.count_if(outside(lat, latitude_bounds) | outside(lon, longitude_bounds)).alias("out_of_bounds_coords"))


def fiscal_year_check(admissions: DataFrame) -> DataFrame:
    return admissions.agg(
        _rows().alias("total_rows"), F.count_if(F.col("fiscal_year").isNull()).alias("missing_fiscal_years"),
    ).withColumn("fiscal_year_check", expectation(
        F.col("missing_fiscal_years") == 0,
        "PASS: Fiscal Year Auto-Generation Complete", "FAIL: NULL Values Found in Fiscal Year"))


def admission_ranges(admissions: DataFrame) -> DataFrame:
    """Admissions and rate must not be negative, population must be positive."""
    invalid = (F.col("admissions") < 0) | (F.col("population") <= 0) | (F.col("standardised_rate") < 0)
    return admissions.agg(
        F.min("admissions").alias("min_admissions"), F.max("admissions").alias("max_admissions"),
        F.min("population").alias("min_population"), F.max("population").alias("max_population"),
        F.min("standardised_rate").alias("min_std_rate"), F.max("standardised_rate").alias("max_std_rate"),
        F.count_if(invalid).alias("invalid_metric_rows"),
    ).withColumn("metric_range_check", expectation(
        F.col("invalid_metric_rows") == 0,
        "PASS: All Numeric Metrics Within Valid Ranges",
        "FAIL: Negative or Zero Values Detected in Metrics"))


def panel_balance(admissions: DataFrame) -> DataFrame:
    """Per condition: periods, wards and rows covered."""
    return admissions.groupBy("health_condition").agg(
        F.min("fiscal_start_date").alias("earliest_start_date"),
        F.max("fiscal_start_date").alias("latest_start_date"),
        F.countDistinct("fiscal_start_date").alias("total_fiscal_periods"),
        F.countDistinct("area_code").alias("wards_covered"), _rows().alias("total_records"))
