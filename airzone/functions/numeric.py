"""Rounding and ratios with SQL NUMERIC behaviour."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def round_half_up(value: Column, digits: int) -> Column:
    """Round half away from zero after fixing binary noise at ten decimals.

    NaN, infinities and values of more than 28 whole digits give NULL, so one bad reading cannot stop a report.
    """
    return F.round(value.try_cast("decimal(38,10)"), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a rounded percentage of ``whole``; NULL when ``whole`` is 0."""
    return round_half_up(F.try_divide(part.cast("double") * 100.0, whole.cast("double")), digits)


def outside(value: Column, bounds: tuple[float, float]) -> Column:
    """NOT BETWEEN, NULL for a NULL value."""
    return ~value.between(*bounds)
