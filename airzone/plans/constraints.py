"""Declared constraints of the input tables, run as audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from airzone.operators.audits import not_null_rules, rule_violations
from airzone.sources import schemas


def traffic_rules() -> dict[str, Column]:
    """Both parts missing, or parts that add up to the total."""
    good, bad, total = (F.col(f"{n}_vehicles") for n in ("compliant", "noncompliant", "total"))
    return {**not_null_rules(["date", "vehicle_type", "total_vehicles"]),
            "parts missing or sum to total": (good.isNull() & bad.isNull()) | (good + bad == total)}


def _required(schema) -> dict[str, Column]:
    return not_null_rules([f.name for f in schema.fields if not f.nullable])


def check_violations(traffic: DataFrame, wards: DataFrame, admissions: DataFrame, *, sites: DataFrame | None = None,
                     readings: DataFrame | None = None, boundaries: DataFrame | None = None) -> DataFrame:
    """Violations of every CHECK and NOT NULL rule, one scan per table."""
    found = [rule_violations(traffic, "traffic", traffic_rules())]
    for name, df, schema in (("wards", wards, schemas.WARDS), ("admissions", admissions, schemas.ADMISSIONS),
                             ("sites", sites, schemas.SITES), ("readings", readings, schemas.READINGS),
                             ("ward_boundaries", boundaries, schemas.WARD_BOUNDARIES)):
        if df is not None:
            found.append(rule_violations(df, name, _required(schema)))
    return reduce(DataFrame.unionByName, found)
