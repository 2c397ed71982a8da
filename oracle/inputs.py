"""The engine's inputs, bound to one folder of test tables."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from airzone.functions.geodesy import with_bng
from airzone.operators.audits import orphans
from airzone.plans import annual, layers, profiles, tiers, traffic as fleet
from airzone.sources import dimensions, files, loading, schemas, snapshots, tables
from oracle import bindings

BASELINE_YEAR = 1997      # the test tables end in 2001


class Inputs:
    """Lazily built inputs and the stages several analyses share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def _view(self, name: str, **frames: DataFrame) -> DataFrame:
        text = bindings.VIEWS[name]
        for table in frames:
            text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
        return self.spark.sql(text, **frames)

    @cached_property
    def readings(self) -> DataFrame:
        return self._view("readings", lineitem=self.table("lineitem"))

    @cached_property
    def staging(self) -> DataFrame:
        return self._view("staging", readings=self.readings)

    @cached_property
    def sites(self) -> DataFrame:
        return self._view("sites", supplier=self.table("supplier"))

    @cached_property
    def wards(self) -> DataFrame:
        return self._view("wards", customer=self.table("customer"))

    @cached_property
    def traffic(self) -> DataFrame:
        return self._view("traffic", orders=self.table("orders"))

    @cached_property
    def admissions(self) -> DataFrame:
        frame = self._view("admissions", orders=self.table("orders"), customer=self.table("customer"))
        return files.with_fiscal_year(frame)

    @cached_property
    def boundaries(self) -> DataFrame:
        return self._view("boundaries", customer=self.table("customer"))

    @cached_property
    def tiers(self) -> DataFrame:
        return dimensions.tiers(self.spark, self._view("outlines", customer=self.table("customer")))

    @cached_property
    def zone(self) -> DataFrame:
        return dimensions.zone(self.spark)

    # ---- shared stages ----

    @cached_property
    def monthly(self) -> DataFrame:
        return annual.monthly_means(self.readings)

    def site_years(self, period: str = "calendar") -> DataFrame:
        """Stored: the reference search and the ratios read it several times."""
        return tables.stage(annual.site_years(self.monthly, period), f"site_years_{period}")

    def annualised(self, period: str = "calendar") -> DataFrame:
        years = self.site_years(period)
        mapping = annual.nearest_reference(years, self.sites, period)
        return annual.annualised_means(years, self.sites, mapping, period)

    @cached_property
    def valid(self) -> DataFrame:
        metrics = annual.site_yearly_metrics(annual.site_years(self.monthly), self.sites)
        return annual.valid_site_years(metrics)

    @cached_property
    def sketches(self) -> DataFrame:
        """Stored: calendar and fiscal years are merged from them."""
        return tables.stage(annual.monthly_sketches(self.readings), "sketches")

    @cached_property
    def profile_state(self) -> DataFrame:
        """Merged from the stored states of two batches of readings."""
        early = F.dayofmonth("date_time") < 16
        return profiles.merged_state(*[tables.stage(profiles.profile_state(self.readings.filter(part)), "profile-state") for part in (early, ~early)])

    @cached_property
    def imputed(self) -> DataFrame:
        """Stored counts: imputation reads its input twice, and the yearly summary reads that twice."""
        return fleet.impute_unrecognised(tables.stage(self.traffic, "traffic"))

    @cached_property
    def yearly_traffic(self) -> DataFrame:
        return fleet.yearly_traffic_summary(self.imputed, baseline_year=BASELINE_YEAR)

    @cached_property
    def site_tiers(self) -> DataFrame:
        return tiers.site_tiers(self.sites, self.zone)

    @cached_property
    def ward_tiers(self) -> DataFrame:
        return tiers.ward_tiers(self.wards, self.zone)

    @cached_property
    def dim_wards(self) -> DataFrame:
        return layers.dim_wards(self.ward_tiers, self.boundaries)

    def loose(self, name: str) -> DataFrame:
        """A table with rows that break its constraints."""
        source = bindings.LOOSE_OF[f"loose_{name}"]
        return self._view(f"loose_{name}", **{source: self.tiers if source == "outlines" else getattr(self, source)})

    # ---- files made from the tables, to exercise the loaders ----

    def csv_copy(self, df: DataFrame, name: str, split: Column | None = None) -> list[str]:
        """Write ``df`` as header CSV; ``split`` sends its true, false and NULL rows to three folders."""
        pieces = [df] if split is None else [df.filter(split), df.filter(~split), df.filter(split.isNull())]
        paths = [tables.new_path(self.spark, name) for _ in pieces]
        for piece, path in zip(pieces, paths):
            piece.write.options(header=True, emptyValue="", ignoreTrailingWhiteSpace=False).csv(path)
        return paths

    @cached_property
    def broken_csv(self) -> list[str]:
        """The staging rows as files: sites of remainder 0 by 7 lack a field, those of remainder 1 have a reading that is no number."""
        rest, rows = F.col("site_id") % 7, self.staging.select(F.col("site_id").cast("string"), "date_time", F.col("no2").cast("string"))
        spoilt = rows.withColumn("no2", F.when(rest == 1, "many").otherwise(F.col("no2")))
        return self.csv_copy(spoilt.filter(rest != 0), "staging") + self.csv_copy(rows.filter(rest == 0).drop("no2"), "short-rows")

    def text_keys(self, df: DataFrame, key: str) -> DataFrame:
        return df.withColumn(key, F.col(key).cast("string"))

    def loaded(self) -> loading.Load:
        """The broken files loaded into a fact that has the even sites."""
        fact, rejects = tables.new_path(self.spark, "fact"), tables.new_path(self.spark, "rejects")
        even = files.load_staged_readings(self.text_keys(self.staging.filter("site_id % 2 = 0 AND site_id % 7 > 1"), "site_id"), rejects="skip")
        snapshots.append(even.withColumn("year", F.year("date_time")), fact, partition_by="year")
        return loading.load_readings(self.spark, self.broken_csv, fact, rejects)

    def refreshed_means(self) -> DataFrame:
        """Monthly means stored without one month, whose year is then replaced."""
        path, late = tables.new_path(self.spark, "monthly"), (F.year("date_time") == 1996) & (F.month("date_time") == 2)
        snapshots.replace_table(annual.monthly_means(self.readings.filter(~late)), path, partition_by="reading_year", sort_by=["site_id"])
        whole = annual.monthly_means(self.readings.filter(F.year("date_time") == 1996))
        return snapshots.replace_partitions(whole, path, [1996], sort_by=["site_id"])

    def updated_wards(self) -> DataFrame:
        """Stored wards whose even ones get projected coordinates and a tier."""
        path = tables.new_path(self.spark, "wards")
        snapshots.replace_table(self.wards.withColumn("part", F.pmod("area_code", F.lit(4)).cast("int")), path, partition_by="part")
        even = with_bng(self.ward_tiers.filter("area_code % 2 = 0"))
        return snapshots.update_rows(even.select("area_code", "x_m", "y_m", "caz_tier"), path, ["area_code"])

    def constraint_audit(self) -> DataFrame:
        """Every declared reference. The summary has one row per site-year of the metrics."""
        years, tier_rows = self.loose("years"), self.loose("tiers")
        metrics = annual.site_yearly_metrics(annual.site_years(self.monthly), self.sites)
        return reduce(DataFrame.unionByName, [
            orphans(self.loose("readings"), "site_id", self.loose("sites"), "site_id", "readings site"),
            orphans(self.loose("admissions"), "area_code", self.loose("wards"), "area_code", "admissions ward"),
            orphans(self.ward_tiers, "caz_tier", tier_rows, "caz_tier", "ward tier"),
            orphans(self.site_tiers, "caz_tier", tier_rows, "caz_tier", "site tier"),
            orphans(self.yearly_traffic, "year", years, "calendar_year", "traffic summary year"),
            orphans(metrics, "reading_year", years, "calendar_year", "site summary year"),
        ])

    def keyed(self) -> dict[str, tuple[DataFrame, list[str]]]:
        frames = {n: self.loose(n) for n in ("readings", "sites", "wards", "traffic", "admissions", "tiers", "years")}
        frames |= {"ward_boundaries": self.loose("boundaries"), "yearly_traffic_summary": self.yearly_traffic,
                   "years (fiscal)": frames["years"]}
        return {name: (df, schemas.KEYS[name]) for name, df in frames.items()}
