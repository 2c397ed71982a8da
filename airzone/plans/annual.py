"""Monthly capture, annual means and annualisation of incomplete site-years.

The raw readings are aggregated once, to one row per site and calendar month.
Calendar and fiscal years are both built from that table; ``period`` chooses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airzone import constants as C
from airzone.functions.calendar import fiscal_year_of, month_hours
from airzone.functions.labels import capture_status, percentile_directive, percentile_status
from airzone.functions.numeric import percent, round_half_up
from airzone.functions.geodesy import with_bng
from airzone.operators import sketches
from airzone.operators.nearest import nearest_place
from airzone.operators.quantiles import grouped_quantiles

PERIOD_COLUMN = {"calendar": "reading_year", "fiscal": "fiscal_year"}


def monthly_means(readings: DataFrame, floor: float = C.SENTINEL_FLOOR) -> DataFrame:
    """Rows, valid rows and valid mean of every site and month."""
    valid = F.when(F.col("no2") >= floor, F.col("no2"))
    return (readings.groupBy("site_id", F.year("date_time").alias("reading_year"),
                             F.month("date_time").alias("reading_month"))
            .agg(F.count(F.lit(1)).alias("total_count"), F.count(valid).alias("valid_count"),
                 F.avg(valid).alias("monthly_mean")))


def with_period(monthly: DataFrame, period: str = "calendar") -> DataFrame:
    if period == "calendar":
        return monthly
    label = fiscal_year_of(F.col("reading_year"), F.col("reading_month"))
    return monthly.withColumn("fiscal_year", label)


def _capture(expected: str) -> Column:
    """Valid share of the rows present, or of the month's hours."""
    slots = {"rows": F.col("total_count"),
             "calendar": month_hours(F.col("reading_year"), F.col("reading_month"))}[expected]
    return F.col("valid_count") / slots


def _with_validity(monthly: DataFrame, period: str, threshold: float, expected: str) -> DataFrame:
    return with_period(monthly, period).withColumn("is_valid_month", _capture(expected) >= threshold)


def laqm_capture_audit(monthly: DataFrame, period: str = "calendar", *,
                       threshold: float = C.CAPTURE_THRESHOLD, expected: str = "rows",
                       pass_months: int = C.PASS_MONTHS, annualise_months: int = C.ANNUALISE_MONTHS) -> DataFrame:
    """Months seen, valid months, mean monthly capture and status of each site-year."""
    share = _capture(expected)
    months = (_with_validity(monthly, period, threshold, expected)
              .withColumn("_pct", percent(share, F.lit(1)).cast("double")))
    return (months.groupBy("site_id", PERIOD_COLUMN[period])
            .agg(F.count("reading_month").alias("total_monitored_months"),
                 F.count_if("is_valid_month").alias("valid_months_count"),
                 round_half_up(F.avg("_pct"), 2).alias("yearly_avg_monthly_capture_pct"))
            .withColumn("laqm_annual_mean_status",
                        capture_status(F.col("valid_months_count"), pass_months, annualise_months)))


def percentile_eligibility(monthly: DataFrame, period: str = "calendar", *,
                           threshold: float = C.CAPTURE_THRESHOLD, expected: str = "rows",
                           pass_months: int = C.PASS_MONTHS, annualise_months: int = C.ANNUALISE_MONTHS) -> DataFrame:
    """Whether a site-year may report its 99.8th percentile, and what to do otherwise."""
    valid = F.col("valid_months_count")
    return (_with_validity(monthly, period, threshold, expected)
            .groupBy("site_id", PERIOD_COLUMN[period])
            .agg(F.count_if("is_valid_month").alias("valid_months_count"))
            .withColumn("percentile_99_8_status", percentile_status(valid, pass_months))
            .withColumn("remediation_instruction", percentile_directive(valid, pass_months, annualise_months)))


def site_years(monthly: DataFrame, period: str = "calendar", *,
               threshold: float = C.CAPTURE_THRESHOLD, expected: str = "rows") -> DataFrame:
    """One row per site-year, carrying its twelve monthly means as a fixed-length array.

    The array lets later steps compare two sites month by month without going
    back to the monthly table.
    """
    month = F.col("reading_month")
    means = F.array(*[F.max(F.when(month == m, F.col("monthly_mean"))) for m in range(1, 13)])
    return (_with_validity(monthly, period, threshold, expected)
            .groupBy("site_id", PERIOD_COLUMN[period])
            .agg(F.count("reading_month").alias("total_monitored_months"),
                 F.count_if("is_valid_month").alias("valid_months_count"),
                 F.avg("monthly_mean").alias("raw_direct_mean"), means.alias("month_means")))


def site_yearly_metrics(site_years: DataFrame, sites: DataFrame, period: str = "calendar", *,
                        pass_months: int = C.PASS_MONTHS, annualise_months: int = C.ANNUALISE_MONTHS) -> DataFrame:
    """Months, direct mean of monthly means and status of each known site's years."""
    return (site_years.join(sites.select("site_id", "site_name"), "site_id")
            .select("site_id", "site_name", PERIOD_COLUMN[period], "total_monitored_months",
                    "valid_months_count", "raw_direct_mean",
                    capture_status(F.col("valid_months_count"), pass_months, annualise_months)
                    .alias("laqm_annual_mean_status")))


def valid_site_years(metrics: DataFrame, period: str = "calendar") -> DataFrame:
    """Site-years whose annual figures may be used directly."""
    return (metrics.filter(F.col("laqm_annual_mean_status").startswith(C.PASS_PREFIX))
            .select("site_id", PERIOD_COLUMN[period], "site_name"))


def nearest_reference(site_years: DataFrame, sites: DataFrame, period: str = "calendar", *,
                      site_type: str = C.REFERENCE_SITE_TYPE, metric: str = "degrees",
                      pass_months: int = C.PASS_MONTHS, annualise_months: int = C.ANNUALISE_MONTHS,
                      **search) -> DataFrame:
    """Reference site of each site-year that needs annualisation.

    The reference is the closest site of ``site_type`` with enough valid months
    in the same year; smallest id on ties. Years without one are left out.
    ``metric`` is planar ``degrees`` or ``bng`` metres. ``site_years`` should be
    a stored table, it is read several times.
    """
    year = PERIOD_COLUMN[period]
    if metric == "bng":
        located = with_bng(sites, x="x", y="y")
        search.setdefault("root_cell", float(2**20))
    else:
        located = sites.withColumns({"x": F.col("longitude"), "y": F.col("latitude")})
    places = located.select("site_id", "x", "y", (F.upper("site_type") == site_type).alias("_is_reference"))
    placed = site_years.select("site_id", year, "valid_months_count").join(places, "site_id")

    targets = (placed.filter(F.col("valid_months_count").between(annualise_months, pass_months - 1))
               .select("site_id", year, "x", "y"))
    eligible = (placed.filter((F.col("valid_months_count") >= pass_months) & F.col("_is_reference"))
                .select(F.col("site_id").alias("assigned_reference_site_id"), year, "x", "y"))
    closest = nearest_place(targets, eligible, year, "assigned_reference_site_id", **search)

    # A missing coordinate on either side makes every distance NULL: any reference will do.
    # One row per year, so its size is bounded by the calendar.
    fallback = eligible.groupBy(year).agg(F.min("assigned_reference_site_id").alias("_any"))
    assigned = F.coalesce("assigned_reference_site_id", "_any")
    return (targets.join(closest, [year, "x", "y"], "left").join(fallback, year)
            .select("site_id", year, assigned.alias("assigned_reference_site_id")))


def _mean(values: Column) -> Column:
    """Mean of an array without its NULLs, added in order."""
    present = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(total, F.size(present))


def annualisation_ratios(site_years: DataFrame, mapping: DataFrame, period: str = "calendar") -> DataFrame:
    """Target and reference means over the months both have, and the reference's full-year mean."""
    year = PERIOD_COLUMN[period]
    target = site_years.select("site_id", year, F.col("month_means").alias("_t"))
    reference = site_years.select(
        F.col("site_id").alias("assigned_reference_site_id"), year,
        F.col("month_means").alias("_r"), F.col("raw_direct_mean").alias("ref_full_year_mean"))
    shared_t = F.zip_with("_t", "_r", lambda t, r: F.when(r.isNotNull(), t))
    shared_r = F.zip_with("_t", "_r", lambda t, r: F.when(t.isNotNull(), r))
    return (mapping.join(target, ["site_id", year])
            .join(reference, ["assigned_reference_site_id", year])
            .select("site_id", year, "assigned_reference_site_id",
                    _mean(shared_t).alias("target_period_mean"),
                    _mean(shared_r).alias("ref_period_mean"), "ref_full_year_mean"))


def annualised_means(site_years: DataFrame, sites: DataFrame, mapping: DataFrame,
                     period: str = "calendar", *, pass_months: int = C.PASS_MONTHS,
                     annualise_months: int = C.ANNUALISE_MONTHS) -> DataFrame:
    """Final mean per site-year: direct, scaled by the reference, or NULL."""
    year = PERIOD_COLUMN[period]
    metrics = site_yearly_metrics(site_years, sites, period, pass_months=pass_months,
                                  annualise_months=annualise_months)
    ratios = annualisation_ratios(site_years, mapping, period)
    valid, direct = F.col("valid_months_count"), F.col("raw_direct_mean")
    scaled = direct * (F.col("ref_full_year_mean") / F.col("ref_period_mean"))
    mean = (F.when(valid >= pass_months, direct)
            .when(valid.between(annualise_months, pass_months - 1) & (F.col("ref_period_mean") > 0), scaled))
    return (metrics.join(ratios, ["site_id", year], "left")
            .select("site_id", "site_name", year, "valid_months_count", "laqm_annual_mean_status",
                    "assigned_reference_site_id", round_half_up(mean, 2).alias("final_annualised_mean")))


def _peak_values(readings: DataFrame, floor: float) -> DataFrame:
    return (readings.filter(F.col("no2") >= floor)
            .select("site_id", F.year("date_time").alias("reading_year"), F.month("date_time").alias("reading_month"), "no2"))


def p998_by_site_year(readings: DataFrame, wanted: DataFrame | None = None, *, floor: float = C.SENTINEL_FLOOR,
                      quantile: float = C.PEAK_QUANTILE) -> DataFrame:
    """Interpolated peak percentile of the valid readings of each site-year, or of those in ``wanted`` only."""
    valid = _peak_values(readings, floor).drop("reading_month")
    if wanted is not None:
        valid = valid.join(wanted.select("site_id", "reading_year"), ["site_id", "reading_year"], "left_semi")
    return grouped_quantiles(valid, ["site_id", "reading_year"], "no2", {"p998_no2_value": quantile})


def monthly_sketches(readings: DataFrame, *, floor: float = C.SENTINEL_FLOOR, k: int = sketches.K) -> DataFrame:
    """A sketch of the valid readings of each site and month, from which years of any kind are merged."""
    return sketches.sketched(_peak_values(readings, floor), ["site_id", "reading_year", "reading_month"], "no2", k=k)


def p998_approx(months: DataFrame, period: str = "calendar", *, quantile: float = C.PEAK_QUANTILE) -> DataFrame:
    """Peak percentile of each site's calendar or fiscal year from ``monthly_sketches``, within their rank error."""
    year = PERIOD_COLUMN[period]
    kept = months if period == "calendar" else months.withColumn(
        year, fiscal_year_of(F.col("reading_year"), F.col("reading_month")))
    return sketches.quantiles(sketches.merged(kept, ["site_id", year]), ["site_id", year], {"p998_no2_value": quantile})


def site_yearly_summary(annualised: DataFrame, readings: DataFrame) -> DataFrame:
    """Annual mean beside the peak percentile, which is worked out for usable years only.

    ``annualised`` should be a stored table: the usable years are read before every pass over the readings.
    """
    usable = annualised.filter(F.col("laqm_annual_mean_status").startswith(C.PASS_PREFIX))
    return (annualised.join(p998_by_site_year(readings, usable), ["site_id", "reading_year"], "left")
            .select("site_id", "site_name", F.col("reading_year").alias("year"),
                    F.col("final_annualised_mean").alias("annualised_mean"), "laqm_annual_mean_status", "p998_no2_value"))


def site_yearly_summary_fy(annualised_fy: DataFrame) -> DataFrame:
    return annualised_fy.select("site_id", "site_name", "fiscal_year", "valid_months_count",
                                "laqm_annual_mean_status", "assigned_reference_site_id",
                                "final_annualised_mean")
