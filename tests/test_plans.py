"""Physical plans: what reaches the scan, what is shuffled, what stays in the JVM."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from airzone.operators.audits import orphans
from airzone.plans import annual, profiles, traffic
from airzone.sources import tables
from oracle.inputs import Inputs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, folder):
    """Readings as a stored table, as in real use."""
    return tables.stage(Inputs(spark, folder).readings.withColumn("extra", F.lit("x")), "plan_readings")


@pytest.fixture(scope="module")
def inputs(spark, folder):
    return Inputs(spark, folder)


def test_filters_and_columns_reach_the_scan(stored, inputs):
    for frame in (profiles.hourly_profile(profiles.profile_state(stored, weekly=False), inputs.valid), profiles.top_n_peaks(stored, inputs.valid),
                  annual.p998_by_site_year(stored)):
        scan = next(line for line in plan_of(frame).splitlines() if "FileScan" in line and "no2" in line)
        assert "GreaterThanOrEqual(no2,-1.0)" in scan
        assert "extra" not in scan


def test_readings_are_aggregated_before_any_shuffle(stored):
    below = plan_of(annual.monthly_means(stored)).split("Exchange hashpartitioning")[1]
    assert "partial_count" in below


def test_peaks_are_limited_before_the_shuffle(stored, inputs):
    plan = plan_of(profiles.top_n_peaks(stored, inputs.valid))
    after = plan.split("WindowGroupLimit")
    assert len(after) == 3 and "Partial" in after[2].splitlines()[0]
    assert "Exchange" in after[1]                                  # between the final and the partial limit


def test_foreign_keys_are_counted_before_they_meet_a_large_dimension(spark, stored, inputs):
    def plan():
        return plan_of(orphans(stored, "site_id", inputs.sites, "site_id", "c"))

    # A dimension known to be small goes to the rows: Catalyst moves the join below the count.
    assert "BroadcastHashJoin" in plan()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        large = plan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert large.index("LeftAnti") < large.index("HashAggregate")     # the count is below the join


def test_imputation_broadcasts_only_the_month_totals(inputs):
    plan = plan_of(traffic.impute_unrecognised(tables.stage(inputs.traffic, "plan_traffic")))
    assert plan.count("BroadcastExchange") == 1
    below = plan.split("BroadcastExchange")[1]
    assert "HashAggregate(keys=[date" in below


def test_tiers_need_no_join(inputs):
    plan = plan_of(inputs.ward_tiers)
    assert "Join" not in plan and "CartesianProduct" not in plan


def test_tier_columns_stay_small_as_join_keys(inputs):
    """Substituting the tier expression into a filter must not blow the plan up."""
    frame = inputs.ward_tiers.filter("caz_tier like '1%'").join(inputs.tiers, "caz_tier")
    assert len(frame._jdf.queryExecution().optimizedPlan().toString()) < 400_000


@pytest.mark.parametrize("name", list(registry.queries()))
def test_no_cross_joins_and_little_python(spark, folder, name):
    plan = plan_of(registry.queries()[name](spark, folder))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in ("map_layer_sites", "map_layer_wards", "oversized_text"):
        assert "Python" not in plan and "InPandas" not in plan
