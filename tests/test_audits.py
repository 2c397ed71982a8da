import datetime

from pyspark.sql import functions as F

from airzone.operators import audits
from airzone.operators.keys import enrich
from airzone.plans import quality

SITES = ("site_id string, site_name string, site_type string, caz_zone string, latitude double, longitude double,"
         " data_source string, start_date date, end_date date")
DAY = datetime.date


def sites(spark):
    return spark.createDataFrame([
        ("a", "One", "ROADSIDE", "INSIDE", 52.4, -1.9, "X", DAY(2020, 1, 1), None),
        ("b", "One", "ROADSIDE", None, 52.7, -1.0, None, DAY(2020, 1, 1), DAY(2019, 1, 1)),
        ("c", "Two", None, None, 52.3, -1.69, "X", DAY(2018, 1, 1), DAY(2021, 1, 1)),
        ("d", None, "URBAN", "INSIDE", None, None, "Y", None, None)], SITES)


def test_site_reports(spark, rows):
    table = sites(spark)
    assert rows(quality.duplicate_names(table)) == [("One", 2, 2)]
    counts = audits.null_counts(table).first()
    assert (counts["total_records"], counts["site_name_nulls"], counts["end_date_nulls"]) == (4, 1, 2)
    # The latitude rule comes first; limits belong to the box; unknown coordinates break no rule.
    assert rows(quality.bbox_violations(table), "site_id", "spatial_flag") == [
        ("b", "Latitude Out of Bounds"), ("c", "Longitude Out of Bounds")]
    assert quality.date_bounds(table).first()["invalid_date_logic_count"] == 1
    assert rows(quality.decommissioned_sites(table), "site_id") == [("b",), ("c",)]


def test_missing_category_is_counted(spark, rows):
    got = rows(audits.category_frequencies(sites(spark), ["site_type", "caz_zone"]))
    assert ("caz_zone", None, 2) in got and ("site_type", None, 1) in got and len(got) == 5


def test_key_audit_counts_repeats_and_missing_keys(spark, rows):
    table = spark.createDataFrame([(1, 1), (1, 1), (1, 1), (2, None), (None, None), (None, None)], "k int, m int")
    assert rows(audits.duplicate_keys(table, ["k", "m"])) == [(1, 1, 3), (None, None, 2)]
    assert rows(audits.key_uniqueness({"t": (table, ["k", "m"])})) == [("t", 2, 3, 3)]
    assert rows(audits.key_uniqueness({"empty": (table.limit(0), ["k"])})) == [("empty", 0, 0, 0)]


def test_missing_foreign_keys_are_no_orphans(spark, rows):
    fact = spark.createDataFrame([("x",), ("x",), ("y",), (None,)], "k string")
    dim = spark.createDataFrame([("y",)], "id string")
    assert rows(audits.orphans(fact, "k", dim, "id", "fk")) == [("fk", "x", 2)]


def test_expectations(spark):
    wards = spark.createDataFrame([("w1", "North"), ("w2", "South ")], "area_code string, area_name string")
    assert quality.ward_count_check(wards).first()["count_check"].startswith("FAIL")
    assert quality.ward_count_check(wards, expected=2).first()["count_check"] == "PASS: All 2 Unique Wards Accounted For"
    assert quality.ward_name_check(wards).first()["name_integrity_check"].startswith("FAIL")
    clean = wards.withColumn("area_name", F.trim("area_name"))
    assert quality.ward_name_check(clean).first()["name_integrity_check"] == "PASS: All Names Unique & Clean"
    panel = spark.createDataFrame([(0, 10, 0.0), (5, 0, 1.0)], "admissions int, population int, standardised_rate double")
    got = quality.admission_ranges(panel).first()
    assert got["invalid_metric_rows"] == 1 and got["metric_range_check"].startswith("FAIL")


def test_readings_reports(spark):
    at = datetime.datetime(2024, 1, 1)
    readings = spark.createDataFrame(
        [("a", at + datetime.timedelta(hours=i), v) for i, v in enumerate([-1.0, 0.0, -0.5, -7.0, 501.0, None])],
        "site_id string, date_time timestamp_ntz, no2 double")
    names = spark.createDataFrame([("a", "One")], "site_id string, site_name string")
    severity = quality.negative_severity(readings, names).first()
    # Zero counts as drift although it is not negative.
    assert (severity["total_negative_readings"], severity["minor_drift_count"], severity["severe_anomaly_count"]) == (3, 3, 1)
    assert float(severity["severe_anomaly_pct_of_site_total"]) == 16.6667
    spread = quality.site_distribution(readings, names).first()
    assert (spread["median_no2"], spread["extreme_spikes"], spread["zero_values"]) == (-0.5, 1, 1)
    horizon = quality.reading_horizon(readings, F.expr("TIMESTAMP_NTZ '2024-01-01 03:00:00'")).first()
    assert horizon["future_readings_count"] == 2


def test_enrich_updates_matched_rows_only(spark, rows):
    dim = spark.createDataFrame([(1, "a", "old"), (2, "b", "old"), (3, "c", "old")], "k int, n string, v string")
    computed = spark.createDataFrame([(1, "new", 1.5), (2, None, 2.5), (9, "x", 9.0)], "k int, v string, d double")
    assert rows(enrich(dim, computed, ["k"])) == [(1, "a", "new", 1.5), (2, "b", None, 2.5), (3, "c", "old", None)]
