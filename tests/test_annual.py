import datetime

from airzone.plans import annual, profiles

READINGS = "site_id string, date_time timestamp_ntz, no2 double"


def hours(site, year, month, values):
    start = datetime.datetime(year, month, 1)
    return [(site, start + datetime.timedelta(hours=i), None if v is None else float(v)) for i, v in enumerate(values)]


def frame(spark, *chunks):
    return spark.createDataFrame([r for c in chunks for r in c], READINGS)


def sites(spark, *rows):
    return spark.createDataFrame(
        list(rows), "site_id string, site_name string, site_type string, latitude double, longitude double")


def test_sentinel_and_capture_edges(spark, rows):
    monthly = annual.monthly_means(frame(
        spark, hours("a", 2024, 1, [-1.0, -1.0001, 0, None]),          # -1 and 0 are valid: 2 of 4
        hours("a", 2024, 2, [5, 5, 5, None]),                          # exactly 75 %
        hours("a", 2024, 3, [1] * 74 + [None] * 26)))                  # 74 %
    assert [(r["reading_month"], r["total_count"], r["valid_count"]) for r in monthly.orderBy("reading_month").collect()] \
        == [(1, 4, 2), (2, 4, 3), (3, 100, 74)]
    audit = annual.laqm_capture_audit(monthly).first()
    assert (audit["total_monitored_months"], audit["valid_months_count"]) == (3, 1)
    assert float(audit["yearly_avg_monthly_capture_pct"]) == 66.33


def test_capture_can_count_calendar_hours(spark):
    monthly = annual.monthly_means(frame(spark, hours("a", 2024, 2, [5] * 600)))      # 600 of 696
    assert annual.laqm_capture_audit(monthly, expected="calendar").first()["valid_months_count"] == 1
    half = annual.monthly_means(frame(spark, hours("a", 2024, 2, [5] * 300)))
    assert annual.laqm_capture_audit(half, expected="calendar").first()["valid_months_count"] == 0
    assert annual.laqm_capture_audit(half).first()["valid_months_count"] == 1


def test_status_edges(spark):
    chunks = [hours(f"s{n}", 2024, m, [10]) for n in (2, 3, 8, 9) for m in range(1, n + 1)]
    eligible = {r["site_id"]: r for r in annual.percentile_eligibility(annual.monthly_means(frame(spark, *chunks))).collect()}
    assert [eligible[s]["percentile_99_8_status"] for s in ("s8", "s9")] == ["INVALID (Seasonal Bias Risk)", "VALID"]
    audit = {r["site_id"]: r["laqm_annual_mean_status"] for r in
             annual.laqm_capture_audit(annual.monthly_means(frame(spark, *chunks))).collect()}
    assert audit == {"s2": "ACTION (Exclude - Insufficient Data)", "s3": "ACTION (Requires Annualisation)",
                     "s8": "ACTION (Requires Annualisation)", "s9": "PASS (Use As-Is)"}


def annualise(spark, readings, dim, period="calendar"):
    years = annual.site_years(annual.monthly_means(readings), period)
    mapping = annual.nearest_reference(years, dim, period)
    return {(r[0], r[2]): r for r in annual.annualised_means(years, dim, mapping, period).collect()}


def test_annualisation(spark):
    dim = sites(spark, ("t", "Target", "ROADSIDE", 52.0, -1.9), ("r", "Ref", "BACKGROUND", 52.1, -1.9),
                ("z", "Alone", "ROADSIDE", 52.0, -1.0))
    readings = frame(
        spark, *[hours("r", 2021, m, [10 * m]) for m in range(1, 13)],
        *[hours("t", 2021, m, [30]) for m in (1, 2, 3)], hours("t", 2021, 4, [-9]),
        *[hours("t", 2022, m, [30]) for m in (1, 2, 3)])
    got = annualise(spark, readings, dim)
    # 30 * mean(10..120) / mean(10, 20, 30); April has no valid target mean and is not compared.
    assert float(got[("t", 2021)]["final_annualised_mean"]) == 97.5
    assert got[("t", 2021)]["assigned_reference_site_id"] == "r"
    assert float(got[("r", 2021)]["final_annualised_mean"]) == 65.0
    assert got[("t", 2022)]["final_annualised_mean"] is None               # no reference that year
    assert got[("t", 2022)]["assigned_reference_site_id"] is None


def test_reference_without_signal_gives_null(spark):
    dim = sites(spark, ("t", "T", "ROADSIDE", 52.0, -1.9), ("r", "R", "BACKGROUND", 52.1, -1.9))
    readings = frame(spark, *[hours("r", 2021, m, [0]) for m in range(1, 13)],
                     *[hours("t", 2021, m, [30]) for m in (1, 2, 3)])
    assert annualise(spark, readings, dim)[("t", 2021)]["final_annualised_mean"] is None


def test_fiscal_years_cross_the_calendar(spark):
    dim = sites(spark, ("r", "R", "BACKGROUND", 52.1, -1.9))
    readings = frame(spark, *[hours("r", 2021, m, [m]) for m in range(4, 13)], *[hours("r", 2022, m, [m]) for m in (1, 2, 3)])
    got = annualise(spark, readings, dim, "fiscal")
    assert list(got) == [("r", "2021/22")] and float(got[("r", "2021/22")]["final_annualised_mean"]) == 6.5
    assert set(annualise(spark, readings, dim)) == {("r", 2021), ("r", 2022)}


def test_summary_hides_percentile_of_unusable_years(spark):
    dim = sites(spark, ("a", "A", "ROADSIDE", 52.0, -1.9), ("b", "B", "ROADSIDE", 52.0, -1.9))
    readings = frame(spark, *[hours("a", 2021, m, [m, 50]) for m in range(1, 10)], hours("b", 2021, 1, [7, 8]))
    years = annual.site_years(annual.monthly_means(readings))
    final = annual.annualised_means(years, dim, annual.nearest_reference(years, dim))
    got = {r["site_id"]: r["p998_no2_value"] for r in
           annual.site_yearly_summary(final, readings).collect()}
    assert got == {"a": 50.0, "b": None}


def test_peaks_and_profiles_use_only_passing_years(spark, rows):
    dim = sites(spark, ("a", "A", "ROADSIDE", 52.0, -1.9), ("b", "B", "ROADSIDE", 52.0, -1.9))
    readings = frame(spark, *[hours("a", 2024, m, [m, m, -5]) for m in range(1, 10)], hours("b", 2024, 1, [99]))
    valid = annual.valid_site_years(annual.site_yearly_metrics(
        annual.site_years(annual.monthly_means(readings), threshold=0.5), dim))
    peaks = profiles.top_n_peaks(readings, valid, n=3)
    assert rows(peaks, "site_id", "month", "hour", "peak_rank") == [("a", 8, 0, 3), ("a", 9, 0, 1), ("a", 9, 1, 2)]
    weekly = profiles.hourly_profile(profiles.profile_state(readings), valid, weekly=True)
    assert weekly.count() == 18                                            # the sentinel hour is gone
    first = weekly.filter("month = 1 and hour = 0").first()
    assert (first["day_of_week_num"], first["day_of_week_name"], first["sample_count"]) == (1, "Monday", 1)


def test_label_and_mean_agree_for_other_limits(spark):
    nine = frame(spark, *[hours("a", 2024, m, [5] * 4) for m in range(1, 10)])
    places = sites(spark, ("a", "A", "Roadside", 52.0, -1.9))
    years = annual.site_years(annual.monthly_means(nine))
    nearest = annual.nearest_reference(years, places, pass_months=10)
    row = annual.annualised_means(years, places, nearest, pass_months=10).first()
    assert not row["laqm_annual_mean_status"].startswith("PASS") and row["final_annualised_mean"] is None
    row = annual.annualised_means(years, places, nearest, pass_months=9).first()
    assert row["laqm_annual_mean_status"].startswith("PASS") and float(row["final_annualised_mean"]) == 5.0
