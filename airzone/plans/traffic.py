"""Imputation of unrecognised vehicles and the yearly fleet summary."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

from airzone import constants as C
from airzone.functions.calendar import fiscal_year
from airzone.functions.numeric import percent, round_half_up


def _with_month_totals(traffic: DataFrame, unrecognised: str) -> DataFrame:
    """Recognised rows beside their month's recognised volume and unrecognised pool.

    The totals have one row per date, so their size is bounded by the calendar
    (under four million days in all of DATE's years) however large ``traffic`` is.
    """
    kind, total = F.col("vehicle_type"), F.col("total_vehicles")
    months = traffic.groupBy("date").agg(
        F.sum(F.when(kind != unrecognised, total)).alias("_recognised"),
        F.sum(F.when(kind == unrecognised, total)).alias("_pool"))
    return traffic.filter(kind != unrecognised).join(months, "date")


def traffic_shares(traffic: DataFrame, unrecognised: str = C.UNRECOGNISED) -> DataFrame:
    """Share of each recognised type in its month's recognised volume."""
    share = F.try_divide(F.col("total_vehicles"), F.col("_recognised"))
    return _with_month_totals(traffic, unrecognised).select(
        "date", "vehicle_type", "compliant_vehicles", "noncompliant_vehicles", "total_vehicles",
        share.alias("category_share"))


def impute_unrecognised(traffic: DataFrame, unrecognised: str = C.UNRECOGNISED) -> DataFrame:
    """Recognised rows, and for months with a pool one imputed row for each of them.

    Each count is the pool times that count over the recognised volume, rounded
    on its own; parts that are missing stay missing. One explode emits both rows,
    so the table is not scanned once per branch.
    """
    measures = ("compliant_vehicles", "noncompliant_vehicles", "total_vehicles")

    def spread(name: str) -> Column:
        part = F.try_divide(F.col("_pool") * F.col(name), F.col("_recognised"))
        return round_half_up(part, 0).cast("int").alias(name)

    baseline = F.struct(*measures, F.lit(C.BASELINE_LABEL).alias("data_source_type"))
    imputed = F.struct(*[spread(n) for n in measures], F.lit(C.IMPUTED_LABEL).alias("data_source_type"))
    rows = F.when(F.col("_pool").isNull(), F.array(baseline)).otherwise(F.array(baseline, imputed))
    return (_with_month_totals(traffic, unrecognised)
            .select("date", "vehicle_type", F.inline(rows)))


def traffic_view(imputed: DataFrame) -> DataFrame:
    """Imputed traffic with calendar and fiscal year."""
    return imputed.select("date", F.year("date").alias("year"), "vehicle_type", "compliant_vehicles",
                          "noncompliant_vehicles", "total_vehicles", "data_source_type",
                          fiscal_year(F.col("date")).alias("fiscal_year"))


def _load_index(compliant: Mapping[str, float], total: Mapping[str, float],
                noncompliant: float, other: float) -> Column:
    """Weighted fleet load of a (year, type) row from its summed counts."""
    def weigh(name: str, weight: float) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) * F.lit(Decimal(str(weight)))

    kind, load = F.col("vehicle_type"), None
    for name, weight in compliant.items():
        value = (weigh("total_non_compliant_vehicles", noncompliant)
                 + weigh("total_compliant_vehicles", weight))
        load = F.when(kind == name, value) if load is None else load.when(kind == name, value)
    for name, weight in total.items():
        load = load.when(kind == name, weigh("total_caz_vehicles", weight))
    return load.otherwise(weigh("total_caz_vehicles", other))


def yearly_traffic_summary(imputed: DataFrame, *, baseline_year: int = C.BASELINE_YEAR,
                           compliant_weights: Mapping[str, float] = C.COMPLIANT_WEIGHTS,
                           total_weights: Mapping[str, float] = C.TOTAL_WEIGHTS,
                           noncompliant_weight: float = C.NONCOMPLIANT_WEIGHT,
                           other_weight: float = C.OTHER_TOTAL_WEIGHT) -> DataFrame:
    """Per year and vehicle type: volumes, non-compliant share, change and load index.

    Changes are against the all-type total of ``baseline_year``, read as one
    value rather than by a window over every row.
    """
    clean, polluting = F.col("total_compliant_vehicles"), F.col("total_non_compliant_vehicles")
    baseline = imputed.filter(F.year("date") == baseline_year).agg(F.struct(
        F.sum("noncompliant_vehicles").alias("polluting"), F.sum("compliant_vehicles").alias("clean"))).scalar()

    yearly = imputed.groupBy(F.year("date").alias("year"), "vehicle_type").agg(
        F.sum("compliant_vehicles").alias("total_compliant_vehicles"),
        F.sum("noncompliant_vehicles").alias("total_non_compliant_vehicles"),
        F.sum("total_vehicles").alias("total_caz_vehicles"))
    return yearly.withColumn("_baseline", baseline).select(
        *yearly.columns, percent(polluting, F.col("total_caz_vehicles")).alias("overall_non_compliant_pct"),
        (polluting - F.col("_baseline.polluting")).alias(f"absolute_change_vs_{baseline_year}_polluters"),
        (clean - F.col("_baseline.clean")).alias(f"absolute_change_vs_{baseline_year}_clean"),
        _load_index(compliant_weights, total_weights, noncompliant_weight, other_weight)
        .alias("estimated_total_pollution_load"))
