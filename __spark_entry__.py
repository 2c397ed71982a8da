"""Registered queries, each with the SQL its result is compared with."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F

from airzone import constants as C
from airzone.functions.calendar import fiscal_year
from airzone.functions.geodesy import with_bng
from airzone.functions.numeric import round_half_up
from airzone.functions.wkt import vertices
from airzone.operators import audits, keys
from airzone.operators.sketches import rank_error
from airzone.plans import annual, constraints, layers, profiles, quality, tiers, traffic
from airzone.sources import dimensions, files, loading, schemas, tables
from oracle.inputs import Inputs
from oracle.sql import ORACLE

try:
    from airzone.llm import queries as llm
except ModuleNotFoundError:      # the subpackage, or a library that only it needs, is not there
    llm = None

SMOKE_DIR = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    """Annualised means from raw readings: the longest chain of the engine."""
    return queries()["annualised_means"](spark, SMOKE_DIR)


def _comparable(df: DataFrame, **digits: int) -> DataFrame:
    """Decimals as doubles; columns named in ``digits`` rounded past summation noise."""
    rounded = df.withColumns({n: round_half_up(F.col(n), d) for n, d in digits.items()})
    return rounded.select(*[
        F.col(n).cast("double").alias(n) if kind.startswith("decimal") else F.col(n)
        for n, kind in rounded.dtypes])


def _definitions() -> dict[str, Callable[[Inputs], DataFrame]]:
    q: dict[str, Callable[[Inputs], DataFrame]] = {}

    # Sources and sinks.
    q["read_csv_sites"] = lambda t: files.read_csv(
        t.spark, t.csv_copy(t.text_keys(t.sites, "site_id"), "sites"), schemas.SITES)
    q["read_csv_wards"] = lambda t: files.read_csv(
        t.spark, t.csv_copy(t.text_keys(t.wards, "area_code"), "wards"), schemas.WARDS,
        ignoreTrailingWhiteSpace=False, ignoreLeadingWhiteSpace=False)
    q["read_csv_traffic"] = lambda t: files.read_csv(t.spark, t.csv_copy(t.traffic, "traffic"), schemas.TRAFFIC)
    q["read_csv_admissions"] = lambda t: _comparable(files.with_fiscal_year(files.read_csv(
        t.spark, t.csv_copy(t.text_keys(t.admissions.drop("fiscal_year"), "area_code"), "admissions"),
        schemas.ADMISSIONS)))
    q["read_many_readings"] = lambda t: files.read_csv(
        t.spark, t.csv_copy(t.text_keys(t.staging, "site_id").select("site_id", "date_time", "no2"),
                            "readings", split=F.col("no2") < 20), schemas.READINGS_STAGING)
    q["parse_timestamp"] = lambda t: files.split_staging(t.staging)[0]
    q["rejected_timestamps"] = lambda t: files.split_staging(t.staging)[1].select("site_id", "date_time", "no2")
    q["dedup_first_wins"] = lambda t: files.load_staged_readings(t.staging, rejects="skip")
    q["insert_ignore"] = lambda t: files.load_staged_readings(
        t.staging, t.readings.filter(F.col("no2").isNull()).select("site_id", "date_time"), rejects="skip")
    q["appended_readings"] = lambda t: _appended(t)
    q["load_report"] = lambda t: files.load_report(
        t.staging, files.load_staged_readings(t.staging.filter(F.col("site_id") % 2 == 0), rejects="skip"))
    q["enrich_sites"] = lambda t: _comparable(keys.enrich(
        t.sites, t.site_tiers.select("site_id", "caz_tier", "distance_to_caz_metres"), ["site_id"]))
    q["fiscal_year_from_start"] = lambda t: t.admissions.select(
        "health_condition", "area_code", "fiscal_start_date", "fiscal_year")
    q["dim_years"] = lambda t: dimensions.years_of(t.readings, F.col("date_time"))
    q["dim_caz_tiers"] = lambda t: _comparable(
        dimensions.tiers(t.spark).select("caz_tier", "tier_description")
        .join(t.ward_tiers.groupBy("caz_tier").agg(F.count(F.lit(1)).alias("wards")), "caz_tier", "left")
        .withColumn("wards", F.coalesce("wards", F.lit(0))))
    q["stored_table"] = lambda t: _stored(t)
    q["load_rejects"] = lambda t: t.loaded().rejects.groupBy(
        F.split("text", ",")[0].alias("site_id"), "reason").agg(F.count(F.lit(1)).alias("rows"))
    q["observed_load"] = lambda t: t.spark.createDataFrame([tuple(t.loaded().counts.values())], loading.COUNTS)
    q["loaded_readings"] = lambda t: t.loaded().readings
    q["refreshed_means"] = lambda t: _comparable(t.refreshed_means(), monthly_mean=6)
    q["updated_wards"] = lambda t: _comparable(t.updated_wards(), x_m=2, y_m=2)

    # Quality.
    q["duplicate_names"] = lambda t: quality.duplicate_names(t.sites)
    q["completeness_sites"] = lambda t: audits.null_counts(t.sites)
    q["category_frequencies"] = lambda t: audits.category_frequencies(
        t.sites, ["site_type", "caz_zone", "data_source"])
    q["bbox_violations"] = lambda t: quality.bbox_violations(t.sites)
    q["date_bounds"] = lambda t: quality.date_bounds(t.sites)
    q["decommissioned_sites"] = lambda t: quality.decommissioned_sites(t.sites)
    q["readings_cleaned"] = lambda t: quality.readings_cleaned(t.readings)
    q["completeness_readings"] = lambda t: _comparable(quality.completeness_readings(t.readings))
    q["reading_horizon"] = lambda t: quality.reading_horizon(
        t.readings, as_of=F.expr("TIMESTAMP_NTZ '2000-01-01 00:00:00'"))
    q["site_distribution"] = lambda t: _comparable(
        quality.site_distribution(t.readings, t.sites), median_no2=4)
    q["negative_severity"] = lambda t: _comparable(quality.negative_severity(t.readings, t.sites))
    q["laqm_capture_audit"] = lambda t: _comparable(annual.laqm_capture_audit(t.monthly))
    q["laqm_capture_audit_fy"] = lambda t: _comparable(annual.laqm_capture_audit(t.monthly, "fiscal"))
    q["percentile_eligibility"] = lambda t: annual.percentile_eligibility(t.monthly)
    q["traffic_quality"] = lambda t: _comparable(quality.traffic_quality(t.traffic))
    q["traffic_stats"] = lambda t: _comparable(
        quality.traffic_stats(t.traffic), median_compliant=4, median_noncompliant=4, median_total=4)
    q["traffic_coverage"] = lambda t: quality.traffic_coverage(t.traffic)
    q["ward_count_check"] = lambda t: quality.ward_count_check(t.wards)
    q["ward_name_check"] = lambda t: quality.ward_name_check(t.wards)
    q["ward_bounds"] = lambda t: quality.ward_bounds(t.wards)
    q["fiscal_year_check"] = lambda t: quality.fiscal_year_check(t.admissions)
    q["admission_ranges"] = lambda t: _comparable(quality.admission_ranges(t.loose("admissions")))
    q["panel_balance"] = lambda t: quality.panel_balance(t.admissions)
    q["duplicate_reading_keys"] = lambda t: audits.duplicate_keys(t.readings, schemas.KEYS["readings"])
    q["key_uniqueness"] = lambda t: audits.key_uniqueness(t.keyed())
    q["fk_orphans"] = lambda t: t.constraint_audit()
    q["check_violations"] = lambda t: constraints.check_violations(
        t.loose("traffic"), t.loose("wards"), t.loose("admissions"), sites=t.loose("sites"), readings=t.loose("readings"),
        boundaries=t.loose("boundaries"))

    # Annual means.
    q["site_yearly_metrics"] = lambda t: _comparable(
        annual.site_yearly_metrics(annual.site_years(t.monthly), t.sites), raw_direct_mean=6)
    q["site_yearly_metrics_fy"] = lambda t: _comparable(annual.site_yearly_metrics(
        annual.site_years(t.monthly, "fiscal"), t.sites, "fiscal"), raw_direct_mean=6)
    q["nearest_reference"] = lambda t: annual.nearest_reference(t.site_years(), t.sites)
    q["nearest_reference_fy"] = lambda t: annual.nearest_reference(t.site_years("fiscal"), t.sites, "fiscal")
    q["nearest_reference_grid"] = lambda t: annual.nearest_reference(t.site_years(), t.sites, leaf_limit=8)
    q["annualisation_ratios"] = lambda t: _comparable(
        _ratios(t), target_period_mean=6, ref_period_mean=6, ref_full_year_mean=6)
    q["annualised_means"] = lambda t: _comparable(t.annualised())
    q["annualised_means_fy"] = lambda t: _comparable(t.annualised("fiscal"))
    q["valid_site_years"] = lambda t: t.valid
    q["p998_by_site_year"] = lambda t: _comparable(annual.p998_by_site_year(t.readings), p998_no2_value=4)
    q["p998_sketch_audit"] = lambda t: _sketch_audit(t, "calendar")
    q["p998_sketch_audit_fy"] = lambda t: _sketch_audit(t, "fiscal")
    q["site_yearly_summary"] = lambda t: _comparable(annual.site_yearly_summary(
        tables.stage(t.annualised(), "annualised"), t.readings), p998_no2_value=4)
    q["site_yearly_summary_fy"] = lambda t: _comparable(annual.site_yearly_summary_fy(t.annualised("fiscal")))

    # Traffic.
    q["traffic_shares"] = lambda t: _comparable(traffic.traffic_shares(t.traffic), category_share=8)
    q["traffic_imputed"] = lambda t: t.imputed
    q["traffic_view"] = lambda t: traffic.traffic_view(t.imputed)
    q["yearly_traffic_summary"] = lambda t: _comparable(t.yearly_traffic)

    # Peaks and profiles.
    q["top_n_peaks"] = lambda t: profiles.top_n_peaks(t.readings, t.valid)
    q["hourly_monthly_profile"] = lambda t: _comparable(profiles.hourly_profile(
        profiles.profile_state(t.readings, weekly=False), t.valid))
    q["hourly_weekly_profile"] = lambda t: _comparable(
        profiles.hourly_profile(profiles.profile_state(t.readings), t.valid, weekly=True))
    q["hourly_weekly_profile_padded"] = lambda t: _comparable(
        profiles.hourly_profile(profiles.profile_state(t.readings), t.valid, weekly=True, padded_names=True))

    q["hourly_profile_from_state"] = lambda t: _comparable(profiles.hourly_profile(t.profile_state, t.valid))

    # Places and maps.
    q["project_points"] = lambda t: _comparable(
        with_bng(t.wards).select("area_code", "x_m", "y_m"), x_m=2, y_m=2)
    q["site_tiers"] = lambda t: _comparable(t.site_tiers)
    q["ward_tiers"] = lambda t: _comparable(t.ward_tiers)
    q["ward_of_site"] = lambda t: tiers.ward_of_site(t.sites, t.boundaries)
    q["wards_about"] = lambda t: tiers.wards_about(t.wards, t.boundaries)
    q["tier_distribution"] = lambda t: _comparable(tiers.tier_distribution(
        {"Monitoring Sites": t.site_tiers, "Municipal Wards": t.ward_tiers}))
    q["geometry_audit"] = lambda t: tiers.geometry_audit(t.zone, t.sites)
    q["boundary_audit"] = lambda t: tiers.outline_audit(t.boundaries, "wd23nm", "wkt", "ward_boundaries")
    q["wkt_vertices"] = lambda t: vertices(t.boundaries, "wd23cd", "wkt")
    q["wkt_rounded"] = lambda t: t.boundaries.select("wd23cd", layers.rounded_wkt(F.col("wkt"), 4).alias("wkt"))
    q["ward_boundary_view"] = lambda t: layers.ward_boundary_view(t.boundaries)
    q["dim_wards"] = lambda t: _comparable(t.dim_wards)
    q["map_layer_sites"] = lambda t: _comparable(layers.map_layer_sites(t.tiers, t.site_tiers))
    q["map_layer_wards"] = lambda t: _comparable(layers.map_layer_wards(t.tiers, t.dim_wards))
    q["oversized_text"] = lambda t: layers.oversized_text(
        layers.map_layer_wards(t.tiers, t.dim_wards), limit=150)
    return q


def _ratios(t: Inputs) -> DataFrame:
    years = t.site_years()
    return annual.annualisation_ratios(years, annual.nearest_reference(years, t.sites))


def _sketch_audit(t: Inputs, period: str) -> DataFrame:
    """Whether the rank of every site-year's sketched percentile is within the stated error."""
    year = annual.PERIOD_COLUMN[period]
    sketched = annual.p998_approx(t.sketches, period)
    at = fiscal_year(F.col("date_time")) if period == "fiscal" else F.year("date_time")
    ranked = (t.readings.filter("no2 >= -1").select("site_id", at.alias(year), "no2").join(sketched, ["site_id", year])
              .groupBy("site_id", year, "n").agg(F.count(F.lit(1)).alias("readings"), F.count_if(F.col("no2") < F.col("p998_no2_value")).alias("below"),
                                                 F.count_if(F.col("no2") <= F.col("p998_no2_value")).alias("up_to")))
    share, error = F.lit(C.PEAK_QUANTILE) * F.col("readings"), F.lit(rank_error()) * F.col("readings")
    return ranked.select("site_id", year, "n", (F.col("n") == F.col("readings")).alias("complete"),
                         ((F.col("below") - 1 <= share + error) & (F.col("up_to") + 1 >= share - error)).alias("within_error"))


def _appended(t: Inputs) -> DataFrame:
    """Half of the sites loaded into a stored fact, then everything, then everything again."""
    path = tables.new_path(t.spark, "readings")
    for batch in (t.staging.filter(F.col("site_id") % 2 == 0), t.staging, t.staging):
        files.append_readings(batch, path, rejects="skip")
    return tables.read_table(t.spark, path)


def _stored(t: Inputs) -> DataFrame:
    """The monthly profile written by year, sorted for pruning, and read back."""
    path = tables.new_path(t.spark, "hourly_monthly_profile")
    tables.write_table(profiles.hourly_profile(profiles.profile_state(t.readings, weekly=False), t.valid), path,
                       partition_by=["year"], sort_by=["site_id", "month", "hour"])
    return _comparable(tables.read_table(t.spark, path))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(define: Callable[[Inputs], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: define(Inputs(spark, folder))

    return {name: bind(define) for name, define in _definitions().items()} | (llm.queries() if llm else {})


def oracle_sql() -> dict[str, str]:
    return ORACLE | (llm.oracle_sql() if llm else {})
