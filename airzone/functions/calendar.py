"""Calendar and fiscal-year expressions. All are free of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from airzone import constants as C


def fiscal_label(start_year: Column) -> Column:
    """``YYYY/YY`` for the fiscal year that begins in ``start_year``."""
    following = ((start_year + 1) % 100).cast("string")
    return F.concat(start_year.cast("string"), F.lit("/"), F.lpad(following, 2, "0"))


def fiscal_year_of(year: Column, month: Column, start_month: int = C.FISCAL_START_MONTH) -> Column:
    """Fiscal year that a calendar (year, month) falls in."""
    return fiscal_label(F.when(month >= start_month, year).otherwise(year - 1))


def fiscal_year(day: Column, start_month: int = C.FISCAL_START_MONTH) -> Column:
    return fiscal_year_of(F.year(day), F.month(day), start_month)


def iso_weekday(day: Column) -> Column:
    """1 = Monday to 7 = Sunday."""
    return F.weekday(day) + 1


def weekday_name(day: Column, padded: bool = False) -> Column:
    """English weekday name; ``padded`` fills it to nine characters."""
    name = F.element_at(F.array(*[F.lit(n) for n in C.WEEKDAYS]), iso_weekday(day))
    return F.rpad(name, 9, " ") if padded else name


def month_hours(year: Column, month: Column) -> Column:
    """Hours in a calendar month."""
    return F.dayofmonth(F.last_day(F.make_date(year, month, F.lit(1)))) * 24


def parse_timestamp(text: Column) -> Column:
    """``DD/MM/YYYY HH24:MI`` text to a zone-less timestamp; NULL when it is not one."""
    iso = F.regexp_replace(text, C.TIMESTAMP_PATTERN, "$3-$2-$1 $4:$5")
    return F.nullif(iso, text).try_cast("timestamp_ntz")     # text that does not match is left as it was
