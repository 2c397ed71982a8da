"""Loads with a reject table and counts of their own."""

import datetime

import pytest
from pyspark.sql import functions as F

from airzone.sources import files, loading, schemas, snapshots

HEADER = "site_id,date_time,no2\n"


def test_every_row_is_stored_or_rejected(spark, tmp_path, rows):
    path = tmp_path / "traffic.csv"
    lines = ["2021-06-01,Car,1,2,3", "2021-06-01,Van,x,2,3", "2021-06-02,Car,1,2", "2021-06-03,Car,1,2,3,4", "yesterday,Car,,2,3",
             '2021-06-04,"a,b",,,9', "2021-06-05,Bus,1,2,1e99"]
    path.write_text("date,vehicle_type,compliant_vehicles,noncompliant_vehicles,total_vehicles\n" + "\n".join(lines) + "\n")
    good, bad = loading.read_csv_checked(spark, str(path), schemas.TRAFFIC)
    assert good.columns == schemas.TRAFFIC.names
    assert rows(good, "vehicle_type", "total_vehicles") == sorted([("Car", 3), ("a,b", 9)], key=repr)
    assert rows(bad, "text", "reason") == sorted([
        (lines[1], "compliant_vehicles: not of type int"), (lines[2], "wrong number of fields"), (lines[3], "wrong number of fields"),
        (lines[4], "date: not of type date"), (lines[6], "total_vehicles: not of type int")], key=repr)
    assert {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"traffic.csv"}


def test_options_reach_the_reasons(spark, tmp_path, rows):
    path = tmp_path / "wards.csv"
    path.write_text("area_code;area_name;latitude;longitude\nE1;One, two;52.5;-1.9\nE2;Three;north;-1.9\n")
    good, bad = loading.read_csv_checked(spark, str(path), schemas.WARDS, sep=";")
    assert rows(good) == [("E1", "One, two", 52.5, -1.9)]
    assert rows(bad, "text", "reason") == [("E2;Three;north;-1.9", "latitude: not of type double")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "none.csv").write_text(HEADER)
    good, bad = loading.read_csv_checked(spark, str(tmp_path / "none.csv"), schemas.READINGS_STAGING)
    assert good.count() == bad.count() == 0
    load = loading.load_readings(spark, str(tmp_path / "none.csv"), str(tmp_path / "fact"), str(tmp_path / "rejects"))
    assert load.counts["rows_read"] == load.counts["kept"] == 0 and load.counts["first_hour"] is None
    assert load.readings.count() == load.rejects.count() == 0


@pytest.fixture
def two_files(tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "A,31/10/2021 01:00,12.5\nA,31/10/2021 01:00,11.5\nA,31/10/2021 02:00,\nA,31/10/2021 03:00,-9999\nA,noon,1\n")
    (tmp_path / "b.csv").write_text(HEADER + "B,31/10/2020 01:00,3\nB,31/10/2020 02:00\nB,31/10/2020 02:00,many\nA,31/10/2021 01:00,12.5\n,,\n")
    return str(tmp_path / "a.csv"), str(tmp_path / "b.csv")


def test_a_load_counts_what_load_report_counts(spark, tmp_path, rows, two_files):
    fact, rejects = str(tmp_path / "fact"), str(tmp_path / "rejects")
    first = loading.load_readings(spark, two_files[0], fact, rejects)
    hour = lambda h, y=2021: datetime.datetime(y, 10, 31, h)
    assert first.counts == {"rows_read": 5, "rejected": 1, "duplicates": 1, "known": 0, "kept": 3, "null_no2": 1, "sentinel_no2": 1,
                            "first_hour": hour(1), "last_hour": hour(3)}
    known = snapshots.read(spark, fact)
    good, _ = loading.read_csv_checked(spark, two_files[1], schemas.READINGS_STAGING)
    plain = files.load_report(good, known).first().asDict()
    second = loading.load_readings(spark, two_files[1], fact, rejects)
    assert second.counts["rows_read"] == 5 and second.counts["rejected"] == plain["rejected"] + 2
    assert {k: second.counts[k] for k in ("duplicates", "known", "kept")} == {k: plain[k] for k in ("duplicates", "known", "kept")} == {"duplicates": 0, "known": 1, "kept": 1}
    assert rows(second.readings) == sorted([("A", hour(1), 11.5, 2021), ("A", hour(2), None, 2021), ("A", hour(3), -9999.0, 2021), ("B", hour(1, 2020), 3.0, 2020)], key=repr)
    assert rows(second.rejects, "batch", "text", "reason") == sorted([
        (0, "A,noon,1.0", "date_time: not a timestamp"), (1, "B,31/10/2020 02:00", "wrong number of fields"),
        (1, "B,31/10/2020 02:00,many", "no2: not of type double"), (1, ",,", "date_time: not a timestamp")], key=repr)
    again = loading.load_readings(spark, list(two_files), fact, rejects)
    assert again.counts["kept"] == 0 and again.readings.count() == 4


def test_the_files_are_read_once(spark, tmp_path, two_files, monkeypatch):
    """Loading and counting leave one scan of CSV: every later step starts from stored rows."""
    scans, real = [], loading.stage

    def watched(df, name):
        scans.append((name, df._jdf.queryExecution().executedPlan().toString().count("FileScan csv")))
        return real(df, name)

    monkeypatch.setattr(loading, "stage", watched)
    monkeypatch.setattr(snapshots, "append", lambda df, *a, _of=snapshots.append, **k: (
        scans.append(("append", df._jdf.queryExecution().executedPlan().toString().count("FileScan csv"))), _of(df, *a, **k))[1])
    loading.load_readings(spark, list(two_files), str(tmp_path / "fact"), str(tmp_path / "rejects"))
    assert scans == [("load", 1), ("load-hours", 0), ("append", 0), ("append", 0)]


def test_a_second_load_reads_only_its_years(spark, tmp_path, two_files):
    loading.load_readings(spark, list(two_files), str(tmp_path / "fact"), str(tmp_path / "rejects"))
    stored = snapshots.read(spark, str(tmp_path / "fact"))
    batch = stored.filter(F.year("date_time") == 2020).select("site_id", "date_time", "no2")
    plan = loading.unknown_rows(batch, stored, schemas.KEYS["readings"])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
