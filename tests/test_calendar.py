import datetime

from pyspark.sql import functions as F

from airzone.functions import calendar
from airzone.functions.numeric import percent, round_half_up
from airzone.sources import dimensions


def one(spark, column, **values):
    frame = spark.range(1).select(*[F.lit(v).alias(n) for n, v in values.items()])
    return frame.select(column).first()[0]


def test_fiscal_year_starts_in_april(spark):
    for day, label in {"2024-03-31": "2023/24", "2024-04-01": "2024/25", "1999-12-01": "1999/00",
                       "2000-01-01": "1999/00", "2009-05-01": "2009/10"}.items():
        assert one(spark, calendar.fiscal_year(F.to_date(F.lit(day))), x=1) == label


def test_weekdays(spark):
    monday, sunday = F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-01-07"))
    assert one(spark, calendar.iso_weekday(monday), x=1) == 1
    assert one(spark, calendar.iso_weekday(sunday), x=1) == 7
    assert one(spark, calendar.weekday_name(sunday), x=1) == "Sunday"
    assert one(spark, calendar.weekday_name(monday, padded=True), x=1) == "Monday   "


def test_parse_timestamp_is_strict_and_zone_free(spark):
    cases = {
        "31/03/2024 01:30": datetime.datetime(2024, 3, 31, 1, 30),   # skipped by British clocks
        "1/2/2024 7:05": datetime.datetime(2024, 2, 1, 7, 5),
        "31/02/2024 00:00": None, "2024-02-01 00:00": None, "01/13/2024 00:00": None, "n/a": None, None: None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/London")
    try:
        frame = spark.createDataFrame([(k,) for k in cases], "t string")
        got = {r[0]: r[1] for r in frame.select("t", calendar.parse_timestamp(F.col("t"))).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == cases


def test_month_hours(spark):
    assert one(spark, calendar.month_hours(F.col("y"), F.col("m")), y=2024, m=2) == 29 * 24


def test_rounding_is_half_away_from_zero(spark):
    assert float(one(spark, round_half_up(F.col("v"), 2), v=2.675)) == 2.68
    assert float(one(spark, round_half_up(F.col("v"), 1), v=-0.25)) == -0.3
    assert float(one(spark, percent(F.col("a"), F.col("b")), a=1, b=3)) == 33.33
    assert one(spark, percent(F.col("a"), F.col("b")), a=1, b=0) is None


def test_year_bridge(spark, rows):
    years = rows(dimensions.years(spark))
    assert len(years) == 8 and years[0] == (2018, "2018/19") and years[-1] == (2025, "2025/26")
