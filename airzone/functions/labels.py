"""Threshold ladders that turn counts and distances into labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airzone import constants as C


def capture_status(valid_months: Column, pass_months: int = C.PASS_MONTHS,
                   annualise_months: int = C.ANNUALISE_MONTHS) -> Column:
    """How the annual mean of a site-year may be used."""
    return (F.when(valid_months >= pass_months, C.STATUS_PASS)
            .when(valid_months >= annualise_months, C.STATUS_ANNUALISE)
            .otherwise(C.STATUS_EXCLUDE))


def percentile_status(valid_months: Column, pass_months: int = C.PASS_MONTHS) -> Column:
    return F.when(valid_months >= pass_months, C.PERCENTILE_VALID).otherwise(C.PERCENTILE_INVALID)


def percentile_directive(valid_months: Column, pass_months: int = C.PASS_MONTHS,
                         annualise_months: int = C.ANNUALISE_MONTHS) -> Column:
    return (F.when(valid_months >= pass_months, C.DIRECTIVE_COMPUTE)
            .when(valid_months >= annualise_months, C.DIRECTIVE_PROXY)
            .otherwise(C.DIRECTIVE_SUPPRESS))


def out_of_bounds_reason(latitude: Column, longitude: Column, *,
                         latitude_bounds=C.LATITUDE_BOUNDS,
                         longitude_bounds=C.LONGITUDE_BOUNDS) -> Column:
    """First failing rule, NULL inside the box."""
    return (F.when(~latitude.between(*latitude_bounds), C.LATITUDE_FLAG)
            .when(~longitude.between(*longitude_bounds), C.LONGITUDE_FLAG))


def tier(inside: Column, distance: Column, straddles: Column | None = None,
         limits=C.TIER_LIMITS) -> Column:
    """Distance tier of a place; ``straddles`` adds the touching-the-edge branch."""
    ladder = F.when(inside, C.TIER_INSIDE)
    if straddles is not None:
        ladder = ladder.when(straddles, C.TIER_STRADDLES)
    for limit, label in limits:
        ladder = ladder.when(distance <= limit, label)
    return ladder.otherwise(C.TIER_OUTER)


def expectation(passed: Column, good: str, bad: str) -> Column:
    return F.when(passed, F.lit(good)).otherwise(F.lit(bad))
