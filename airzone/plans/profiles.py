"""Peak hours and hour-of-day profiles of site-years with usable data.

A site-year is usable or not as a whole, so readings are ranked or aggregated
first and only the much smaller result meets the list of usable site-years.
The raw readings are never shuffled for that join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from airzone import constants as C
from airzone.functions.calendar import iso_weekday
from airzone.functions.numeric import round_half_up
from airzone.operators.keys import top_n


def _usable(valid: DataFrame) -> DataFrame:
    return valid.select("site_id", F.col("reading_year").alias("year"), "site_name")


def top_n_peaks(readings: DataFrame, valid: DataFrame, n: int = C.PEAK_HOURS,
                floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """The ``n`` highest hours of each usable site-year, earliest first on ties."""
    hours = (readings.filter(F.col("no2") >= floor)
             .select("site_id", F.year("date_time").alias("year"), "date_time", "no2"))
    peaks = top_n(hours, ["site_id", "year"], [F.desc("no2"), F.asc("date_time")], n, "peak_rank")
    at = F.col("date_time")
    return (peaks.join(_usable(valid), ["site_id", "year"])
            .select("site_id", "site_name", "year", F.month(at).alias("month"),
                    F.dayofmonth(at).alias("day"), F.hour(at).alias("hour"),
                    at.alias("exact_timestamp"), F.col("no2").alias("hourly_no2_value"), "peak_rank"))


#: Columns of a profile's state behind the site: its grain.
GRAIN = ("year", "month", "day_of_week_num", "hour")


def profile_state(readings: DataFrame, *, weekly: bool = True, floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """What a profile needs to know of the valid readings: sum, count and maximum by site, year, month, weekday and hour.

    States add up: a stored one, made a batch at a time, stands in for the readings behind it. Without ``weekly`` it
    has no weekday and serves monthly profiles only.
    """
    at = F.col("date_time")
    parts = {"year": F.year(at), "month": F.month(at), "day_of_week_num": iso_weekday(at), "hour": F.hour(at)}
    return (readings.filter(F.col("no2") >= floor)
            .groupBy("site_id", *[parts[n].alias(n) for n in GRAIN if weekly or n != "day_of_week_num"])
            .agg(F.sum("no2").alias("sum_no2"), F.count("no2").alias("sample_count"), F.max("no2").alias("max_no2")))


def merged_state(*states: DataFrame) -> DataFrame:
    """One state from those of separate batches of readings, at the grain of the first."""
    every = reduce(DataFrame.unionByName, states)
    return _summed(every, [n for n in ("site_id", *GRAIN) if n in every.columns])


def _summed(state: DataFrame, keys: list[str]) -> DataFrame:
    return state.groupBy(*keys).agg(
        F.sum("sum_no2").alias("sum_no2"), F.sum("sample_count").alias("sample_count"), F.max("max_no2").alias("max_no2"))


def hourly_profile(state: DataFrame, valid: DataFrame, *, weekly: bool = False, padded_names: bool = False) -> DataFrame:
    """Mean, maximum and count by site, year, month and hour; ``weekly`` adds the weekday.

    ``state`` is a ``profile_state`` at the wanted grain or a finer one.
    """
    grain = [n for n in GRAIN if weekly or n != "day_of_week_num"]
    profile = state if all(n in ("site_id", *grain) for n in state.columns if n in GRAIN) else _summed(state, ["site_id", *grain])
    profile = profile.select("site_id", *grain, round_half_up(F.try_divide("sum_no2", "sample_count"), 2).alias("avg_hourly_no2"),
                             F.col("max_no2").alias("max_hourly_no2"), "sample_count")
    if weekly:
        names = F.array(*[F.lit(n.ljust(9) if padded_names else n) for n in C.WEEKDAYS])
        profile = profile.withColumn("day_of_week_name", F.element_at(names, F.col("day_of_week_num")))
    days = ["day_of_week_num", "day_of_week_name"] if weekly else []
    return (profile.join(_usable(valid), ["site_id", "year"])
            .select("site_id", "site_name", "year", "month", *days, "hour",
                    "avg_hourly_no2", "max_hourly_no2", "sample_count"))
