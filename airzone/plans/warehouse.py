"""Base and derived tables in build order, stored.

Every base table is evaluated once and stored first; each later table is built
from stored ones, so its plan starts from Parquet with known sizes, column
pruning and row-group skipping, and no input is parsed or deduplicated again.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from airzone import constants as C
from airzone.plans import annual, layers, profiles, tiers, traffic
from airzone.sources import dimensions, files, schemas, snapshots
from airzone.sources.tables import stage


@dataclass
class BaseTables:
    """Inputs, in the shapes of ``airzone.sources.schemas``."""

    sites: DataFrame
    readings: DataFrame
    traffic: DataFrame
    wards: DataFrame
    boundaries: DataFrame
    zone: DataFrame
    tiers: DataFrame
    admissions: DataFrame | None = None


@dataclass
class Warehouse:
    """Stored tables by name, under one folder."""

    spark: SparkSession
    folder: str
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def refresh(self, name: str, df: DataFrame, partition_by: str | None = None, sort_by=(), years: list[int] | None = None) -> DataFrame:
        """Replace a table, or only its partitions ``years``, and return the stored one.

        Readers see the old table until the new one is whole.
        """
        path = f"{self.folder}/{name}"
        self.tables[name] = (snapshots.replace_table(df, path, partition_by=partition_by, sort_by=sort_by) if years is None
                             else snapshots.replace_partitions(df, path, years, sort_by=sort_by))
        return self.tables[name]

    def view(self, name: str, df: DataFrame) -> DataFrame:
        """A named query, evaluated when read."""
        self.tables[name] = df
        return df

    def register(self) -> None:
        """Make every table and view available to SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(name)


def _store_base(house: Warehouse, base: BaseTables) -> BaseTables:
    """The base tables as stored ones. Readings lie by year, site and time; sites and wards are stored with their tier."""
    readings = house.refresh("no2_readings", base.readings.withColumn("reading_year", F.year("date_time")),
                             partition_by="reading_year", sort_by=["site_id", "date_time"])
    house.refresh("dim_years", dimensions.years_of(readings, F.col("date_time")))
    if base.admissions is not None:
        house.refresh("hospital_admissions", base.admissions)
    return replace(base, readings=readings.drop("reading_year"),
                   traffic=house.refresh("caz_traffic_compliance", base.traffic, sort_by=["date", "vehicle_type"]),
                   boundaries=house.refresh("ward_boundaries", base.boundaries))


def _build_places(house: Warehouse, base: BaseTables) -> None:
    sites = house.refresh("monitoring_sites", tiers.site_tiers(base.sites, base.zone))
    wards = house.refresh("wards_metadata", tiers.ward_tiers(base.wards, base.zone))
    outlines = house.refresh("dim_caz_tiers", base.tiers)
    house.view("vw_hospital_wards_map", layers.ward_boundary_view(base.boundaries))
    dim_wards = house.view("vw_dim_wards", layers.dim_wards(wards, base.boundaries))
    house.view("vw_caz_and_sites_map", layers.map_layer_sites(outlines, sites))
    house.view("vw_caz_and_wards_map", layers.map_layer_wards(outlines, dim_wards))


def _of_years(df: DataFrame, years: list[int] | None, column: str = "reading_year") -> DataFrame:
    return df if years is None else df.filter(F.col(column).isin(years))


def _build_annual(house: Warehouse, years: list[int] | None = None) -> None:
    """Monthly means and what follows from them. Calendar tables lie by year, so that some ``years`` can be built alone;
    fiscal tables, a row per site and year, are built whole from the stored monthly means."""
    sites, readings = house.tables["monitoring_sites"], _of_years(house.tables["no2_readings"], years)
    monthly = house.refresh("stg_monthly_means", annual.monthly_means(readings), "reading_year", ["site_id"], years)
    for period, suffix in (("calendar", ""), ("fiscal", "_fy")):
        by, some = ("reading_year", years) if period == "calendar" else (None, None)

        def stored(name: str, df: DataFrame) -> DataFrame:
            return _of_years(house.refresh(name + suffix, df, by, years=some), some)

        site_years = stored("stg_site_years", annual.site_years(_of_years(monthly, some), period))
        stored("stg_site_yearly_metrics", annual.site_yearly_metrics(site_years, sites, period))
        mapping = stored("stg_reference_mapping", annual.nearest_reference(site_years, sites, period))
        stored("stg_final_annualised_means", annual.annualised_means(site_years, sites, mapping, period))
    final = _of_years(house.tables["stg_final_annualised_means"], years)
    house.refresh("analytics_site_yearly_summary", annual.site_yearly_summary(final, readings), "year", years=years)
    house.view("analytics_site_yearly_summary_fy",
               annual.site_yearly_summary_fy(house.tables["stg_final_annualised_means_fy"]))


def _build_profiles(house: Warehouse, state: DataFrame, years: list[int] | None = None) -> None:
    valid = _of_years(annual.valid_site_years(house.tables["stg_final_annualised_means"]), years)
    readings, lookup = _of_years(house.tables["no2_readings"], years), ["site_id", "month"]
    house.refresh("analytics_top19_hourly_peaks", profiles.top_n_peaks(readings, valid), "year", ["site_id", "peak_rank"], years)
    state = _of_years(house.refresh("stg_profile_state", state, "year", lookup, years), years, "year")
    house.refresh("analytics_site_hourly_monthly_profiles", profiles.hourly_profile(state, valid), "year", [*lookup, "hour"], years)
    house.refresh("analytics_site_hourly_weekly_profiles", profiles.hourly_profile(state, valid, weekly=True),
                  "year", [*lookup, "day_of_week_num", "hour"], years)


def _build_traffic(house: Warehouse, base: BaseTables, baseline_year: int) -> None:
    imputed = house.refresh("analytics_imputed_traffic_monthly", traffic.impute_unrecognised(base.traffic),
                            sort_by=["date", "vehicle_type", "data_source_type"])
    house.view("vw_powerbi_traffic", traffic.traffic_view(imputed))
    house.refresh("analytics_yearly_traffic_summary",
                  traffic.yearly_traffic_summary(imputed, baseline_year=baseline_year))


def build(spark: SparkSession, base: BaseTables, folder: str,
          baseline_year: int = C.BASELINE_YEAR) -> Warehouse:
    """Build or refresh every table under ``folder``, which must not hold the inputs themselves."""
    house = Warehouse(spark, folder)
    base = _store_base(house, base)
    _build_places(house, base)
    _build_annual(house)
    _build_profiles(house, profiles.profile_state(base.readings))
    _build_traffic(house, base, baseline_year)
    return house


def add_readings(house: Warehouse, batch: DataFrame) -> list[int]:
    """Append the hours of ``batch`` (site_id, date_time, no2) that the fact lacks, and refresh what follows from them.

    Returns the years with new hours. Their readings are read again for monthly means, percentiles and peaks; the
    stored profile state of these years only takes up that of the new hours. Other years keep their files in every
    table that lies by year. The driver reads the batch's years and nothing else.
    """
    keys = schemas.KEYS["readings"]
    hours = stage(files.one_per_hour(batch.select(*keys, "no2")), "batch").withColumn("reading_year", F.year("date_time"))
    batch_years = [r[0] for r in hours.select("reading_year").distinct().collect()]
    known = _of_years(house.tables["no2_readings"], batch_years).select(*keys)
    fresh = stage(hours.join(known, keys, "left_anti"), "new-hours")
    years = sorted(r[0] for r in fresh.select("reading_year").distinct().collect())
    if not years:
        return []
    house.tables["no2_readings"] = snapshots.append(fresh, f"{house.folder}/no2_readings", sort_by=["site_id", "date_time"])
    days = house.tables["dim_years"].select(F.make_date("calendar_year", F.lit(1), F.lit(1)).alias("d")).unionByName(
        fresh.select(F.to_date("date_time").alias("d")))
    house.refresh("dim_years", dimensions.years_of(days, F.col("d")))
    _build_annual(house, years)
    before = _of_years(house.tables["stg_profile_state"], years, "year")
    _build_profiles(house, profiles.merged_state(before, profiles.profile_state(fresh)), years)
    return years
