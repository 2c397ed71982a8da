import pytest
from pyspark.sql import functions as F

from airzone.operators import audits
from airzone.plans import profiles, warehouse
from airzone.sources import snapshots, tables
from oracle.compare import connect, rows_of
from oracle.inputs import BASELINE_YEAR, Inputs
import __spark_entry__ as registry

SAME_AS_QUERY = {
    "monitoring_sites": "site_tiers", "wards_metadata": "ward_tiers",
    "stg_site_yearly_metrics": "site_yearly_metrics", "stg_reference_mapping": "nearest_reference",
    "stg_reference_mapping_fy": "nearest_reference_fy", "stg_final_annualised_means": "annualised_means",
    "stg_final_annualised_means_fy": "annualised_means_fy", "analytics_site_yearly_summary": "site_yearly_summary",
    "analytics_site_yearly_summary_fy": "site_yearly_summary_fy", "analytics_top19_hourly_peaks": "top_n_peaks",
    "analytics_site_hourly_monthly_profiles": "hourly_monthly_profile",
    "analytics_site_hourly_weekly_profiles": "hourly_weekly_profile",
    "analytics_imputed_traffic_monthly": "traffic_imputed", "analytics_yearly_traffic_summary": "yearly_traffic_summary",
    "vw_powerbi_traffic": "traffic_view", "vw_dim_wards": "dim_wards", "vw_hospital_wards_map": "ward_boundary_view",
    "vw_caz_and_sites_map": "map_layer_sites", "vw_caz_and_wards_map": "map_layer_wards"}


SOURCES = ("sites", "readings", "traffic", "wards", "boundaries", "admissions")


@pytest.fixture(scope="module")
def built(spark, folder, tmp_path_factory):
    t = Inputs(spark, folder)
    counted = {n: spark.sparkContext.accumulator(0) for n in SOURCES}

    def watched(name):
        """The table, with a count of every row that is read from it."""
        df, seen = getattr(t, name), counted[name]

        def passed(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch

        return df.mapInArrow(passed, df.schema)

    base = warehouse.BaseTables(**{n: watched(n) for n in SOURCES}, zone=t.zone, tiers=t.tiers)
    house = warehouse.build(spark, base, str(tmp_path_factory.mktemp("warehouse")), baseline_year=BASELINE_YEAR)
    house.counted = {n: (a.value, getattr(t, n).count()) for n, a in counted.items()}
    return house


def test_every_base_row_is_read_once(built):
    assert all(seen == rows > 0 for seen, rows in built.counted.values()), built.counted


def test_years_join_readings_and_admissions_by_name(spark, built):
    built.register()
    assert spark.sql("SELECT count(*) FROM hospital_admissions a JOIN dim_years y ON y.fiscal_year = a.fiscal_year "
                     "JOIN (SELECT DISTINCT reading_year FROM no2_readings) r ON r.reading_year = y.calendar_year").first()[0] > 0


@pytest.mark.parametrize("table, query", SAME_AS_QUERY.items())
def test_stored_tables_match_sql(spark, folder, built, table, query):
    frame = registry._comparable(built.tables[table], **{
        n: d for n, d in {"raw_direct_mean": 6, "p998_no2_value": 4}.items() if n in built.tables[table].columns})
    result = connect(folder).sql(registry.oracle_sql()[query])
    assert rows_of(frame.collect(), frame.columns) == rows_of(result.fetchall(), result.columns)


def test_tables_are_queryable_by_name(spark, built):
    built.register()
    assert spark.sql("SELECT count(*) FROM vw_powerbi_traffic v JOIN analytics_yearly_traffic_summary s "
                     "ON v.year = s.year AND v.vehicle_type = s.vehicle_type").first()[0] > 0


def test_keys_of_the_derived_tables_are_unique(built):
    keys = {"stg_final_annualised_means": ["site_id", "reading_year"], "stg_reference_mapping": ["site_id", "reading_year"],
            "analytics_yearly_traffic_summary": ["year", "vehicle_type"],
            "analytics_top19_hourly_peaks": ["site_id", "year", "peak_rank"]}
    audit = audits.key_uniqueness({n: (built.tables[n], k) for n, k in keys.items()})
    assert all(r["surplus_rows"] == 0 and r["null_key_rows"] == 0 for r in audit.collect())


def test_both_profiles_come_from_one_stored_state(spark, folder, built):
    """A whole state equals the merged states of two batches, at either grain."""
    t = Inputs(spark, folder)
    state, plain = built.tables["stg_profile_state"].drop("year_"), ["site_id", *profiles.GRAIN, "sample_count", "max_no2"]
    early = F.dayofmonth("date_time") < 16
    merged = profiles.merged_state(*[profiles.profile_state(t.readings.filter(part)) for part in (early, ~early)])
    assert merged.select(*plain).exceptAll(state.select(*plain)).count() == 0 == state.select(*plain).exceptAll(merged.select(*plain)).count() and state.count() > 0
    monthly = profiles.hourly_profile(profiles.profile_state(t.readings, weekly=False), t.valid)
    assert rows_of(profiles.hourly_profile(merged, t.valid).collect(), monthly.columns) == rows_of(monthly.collect(), monthly.columns)


def test_an_appended_month_gives_the_tables_of_a_full_build(spark, folder, built, tmp_path):
    """Only tables' partitions of its year are written; other years keep their files."""
    t = Inputs(spark, folder)
    month = (F.year("date_time") == 1996) & (F.month("date_time") == 2)
    house = warehouse.build(spark, warehouse.BaseTables(t.sites, t.readings.filter(~month), t.traffic, t.wards, t.boundaries, t.zone, t.tiers,
                                                        t.admissions), str(tmp_path / "house"), baseline_year=BASELINE_YEAR)
    by_year = ["no2_readings", "stg_monthly_means", "stg_site_years", "stg_final_annualised_means", "analytics_site_yearly_summary",
               "analytics_top19_hourly_peaks", "stg_profile_state", "analytics_site_hourly_weekly_profiles"]
    before = {n: set(house.tables[n].inputFiles()) for n in by_year}
    overlap = t.readings.filter(month | (F.dayofmonth("date_time") == 1))              # known hours come again
    assert warehouse.add_readings(house, overlap) == [1996]
    assert warehouse.add_readings(house, overlap) == []
    for name in by_year:
        after = set(house.tables[name].inputFiles())
        assert {f for f in before[name] if "year=1996" not in f} == {f for f in after if "year=1996" not in f}, name
        assert after != before[name] and snapshots.read(spark, f"{house.folder}/{name}").count() == house.tables[name].count()
    skipped = ("vw_",)
    for name, whole in built.tables.items():
        if name.startswith(skipped):
            continue
        columns = [F.round(c, 6).alias(c) if k == "double" else F.transform(c, lambda v: F.round(v, 6)).alias(c) if k == "array<double>" else c
                   for c, k in whole.dtypes]
        assert rows_of(house.tables[name].select(*columns).collect(), whole.columns) == rows_of(whole.select(*columns).collect(), whole.columns), name


def test_a_table_that_is_not_there_is_none(spark, tmp_path):
    assert tables.read_if_there(spark, str(tmp_path / "none"), "a int") is None
    spark.range(3).write.parquet(str(tmp_path / "some"))
    assert tables.read_if_there(spark, str(tmp_path / "some"), "id long").count() == 3
