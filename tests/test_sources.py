import datetime

import pytest
from pyspark.sql import functions as F

from airzone.operators.keys import first_per_key, insert_ignore
from airzone.sources import files, schemas, tables

BOM = "﻿"


def test_csv_with_byte_order_mark_and_empty_cells(spark, tmp_path):
    path = tmp_path / "sites.csv"
    path.write_text(BOM + "site_id,site_name,site_type,caz_zone,latitude,longitude,data_source,start_date,end_date\n"
                    "A1,First Street,ROADSIDE,INSIDE,52.48,-1.9,BCC,2018-07-26,\n"
                    "A2,\"Second, North\",BACKGROUND,OUTSIDE,52.5,-1.8,DEFRA,2006-11-21,2025-07-10\n", encoding="utf-8")
    got = files.read_csv(spark, str(path), schemas.SITES).orderBy("site_id").collect()
    assert [r["site_id"] for r in got] == ["A1", "A2"]
    assert got[0]["end_date"] is None and got[1]["end_date"] == datetime.date(2025, 7, 10)
    assert got[1]["site_name"] == "Second, North"


def test_malformed_row_stops_the_load(spark, tmp_path):
    path = tmp_path / "traffic.csv"
    path.write_text("date,vehicle_type,compliant_vehicles,noncompliant_vehicles,total_vehicles\n2021-06-01,Car,x,1,2\n")
    with pytest.raises(Exception, match="MALFORMED"):
        files.read_csv(spark, str(path), schemas.TRAFFIC).collect()


def test_many_files_to_clean_readings(spark, tmp_path, rows):
    header = "site_id,date_time,no2\n"
    (tmp_path / "a.csv").write_text(header + "A,31/10/2021 01:00,12.5\nA,31/10/2021 01:00,11.5\nA,31/10/2021 02:00,\n")
    (tmp_path / "b.csv").write_text(header + "B,31/10/2021 01:00,3\nB,bad,4\n")
    staging = files.read_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], schemas.READINGS_STAGING)
    with pytest.raises(Exception, match="not a timestamp: bad"):
        files.load_staged_readings(staging).collect()
    clean = files.load_staged_readings(staging, rejects="skip")
    one, two = datetime.datetime(2021, 10, 31, 1), datetime.datetime(2021, 10, 31, 2)
    assert rows(clean) == sorted([("A", one, 11.5), ("A", two, None), ("B", one, 3.0)], key=repr)
    assert rows(files.split_staging(staging)[1]) == [("B", "bad", 4.0)]
    known = clean.filter("site_id = 'A'")
    assert rows(files.load_staged_readings(staging, known, rejects="skip")) == [("B", one, 3.0)]
    assert rows(files.load_report(staging, known)) == [(5, 1, 1, 2, 1)]


def test_valid_reading_wins_over_an_instrument_error(spark, rows):
    hour = datetime.datetime(2021, 10, 31, 1)
    staging = spark.createDataFrame([("A", "31/10/2021 01:00", v) for v in (-9999.0, 35.0, 36.0, None)], "site_id string, date_time string, no2 double")
    assert rows(files.load_staged_readings(staging)) == [("A", hour, 35.0)]


def test_second_load_adds_nothing_and_reads_only_its_years(spark, rows, tmp_path):
    staging = spark.createDataFrame([("A", f"31/10/{y} 01:00", 1.0) for y in (2019, 2020, 2021)], "site_id string, date_time string, no2 double")
    path = str(tmp_path / "fact")
    for _ in range(2):
        files.append_readings(staging, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3
    plan = files.load_staged_readings(staging.filter("date_time LIKE '%2020%'"), stored)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "2020" in plan


@pytest.mark.parametrize("value,expected", [(float("nan"), None), (float("inf"), None), (-float("inf"), None), (1e19, 1e19), (2.004, 2.0), (2.005, 2.01)])
def test_rounding_never_stops_a_report(spark, value, expected):
    from pyspark.sql import functions as F
    from airzone.functions.numeric import round_half_up
    got = spark.createDataFrame([(value,)], "x double").select(round_half_up(F.col("x"), 2)).first()[0]
    assert (None if got is None else float(got)) == expected


def test_insert_ignore_keeps_whole_rows(spark, rows):
    new = spark.createDataFrame([(1, "b", 9), (1, "a", 10), (2, None, 1), (2, "z", 0), (3, None, None)],
                                "k int, name string, v int")
    assert rows(insert_ignore(new, None, ["k"])) == [(1, "a", 10), (2, "z", 0), (3, None, None)]
    assert rows(insert_ignore(new, new.filter("k = 2"), ["k"])) == [(1, "a", 10), (3, None, None)]
    assert rows(first_per_key(new, ["k"], [F.desc_nulls_last("v")]))[0] == (1, "a", 10)


def test_fiscal_year_of_admissions(spark, rows):
    frame = spark.createDataFrame([(datetime.date(2019, 4, 1),), (datetime.date(1999, 4, 1),)], "fiscal_start_date date")
    assert rows(files.with_fiscal_year(frame), "fiscal_year") == [("1999/00",), ("2019/20",)]


def test_stored_table_layout_and_pruning(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = spark.range(2000).select((F.col("id") % 3 + 2020).alias("year"), (F.col("id") % 40).alias("site_id"),
                                     F.rand(1).alias("v"))
    for _ in range(2):                                              # a refresh replaces
        tables.write_table(frame, path, partition_by=["year"], sort_by=["site_id"])
    stored = tables.read_table(spark, path)
    assert stored.count() == 2000
    plan = stored.filter("year = 2021 and site_id = 7").select("v")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan and "EqualTo(site_id,7)" in plan


def test_stage_is_read_back_from_the_shared_folder(spark):
    staged = tables.stage(spark.range(5), "numbers")
    plan = staged._jdf.queryExecution().executedPlan().toString()
    assert staged.count() == 5 and "FileScan parquet" in plan
    assert staged.inputFiles()[0].removeprefix("file://").startswith(tables.shared_dir(spark).removeprefix("file:"))
