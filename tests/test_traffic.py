import datetime

from airzone.operators.audits import rule_violations
from airzone.plans import constraints, quality, traffic

SCHEMA = "date date, vehicle_type string, compliant_vehicles int, noncompliant_vehicles int, total_vehicles int"
JUNE = datetime.date(2021, 6, 1)
MONTH = [("Bus/Coach", 565, 4, 569), ("Car", 66047, 11344, 77391), ("Exempt", 1145, 522, 1667), ("HGV", 1013, 86, 1099),
         ("LGV", 6265, 2873, 9138), ("Mini-Bus", 57, 26, 83), ("Motorcycles and Other", None, None, 238)]


def frame(spark, *records):
    return spark.createDataFrame(list(records), SCHEMA)


def test_one_month_by_hand(spark):
    table = frame(spark, *[(JUNE, *m) for m in MONTH], (JUNE, "Unrecognised", None, None, 7422))
    imputed = traffic.impute_unrecognised(table).filter("data_source_type = 'Imputed Unrecognised'")
    got = {r["vehicle_type"]: (r["total_vehicles"], r["compliant_vehicles"], r["noncompliant_vehicles"])
           for r in imputed.collect()}
    # Parts are rounded on their own and need not add up to the imputed total.
    assert got == {"Bus/Coach": (47, 46, 0), "Car": (6369, 5436, 934), "Exempt": (137, 94, 43), "HGV": (90, 83, 7),
                   "LGV": (752, 516, 236), "Mini-Bus": (7, 5, 2), "Motorcycles and Other": (20, None, None)}


def test_months_without_pool_or_recognised_rows(spark, rows):
    may, july = datetime.date(2021, 5, 1), datetime.date(2021, 7, 1)
    table = frame(spark, (may, "Car", 3, 1, 4), (JUNE, "Unrecognised", None, None, 9),
                  (july, "Car", 0, 0, 0), (july, "Unrecognised", None, None, 5))
    assert rows(traffic.impute_unrecognised(table)) == sorted([
        (may, "Car", 3, 1, 4, "Recognised Baseline"), (july, "Car", 0, 0, 0, "Recognised Baseline"),
        (july, "Car", None, None, None, "Imputed Unrecognised")], key=repr)


def test_shares_add_up(spark):
    shares = traffic.traffic_shares(frame(spark, *[(JUNE, *m) for m in MONTH], (JUNE, "Unrecognised", None, None, 7)))
    assert abs(shares.groupBy().sum("category_share").first()[0] - 1) < 1e-12


def test_yearly_summary(spark):
    imputed = traffic.impute_unrecognised(frame(
        spark, (datetime.date(2022, 1, 1), "Car", 80, 20, 100), (datetime.date(2022, 3, 1), "LGV", 10, 10, 20),
        (datetime.date(2023, 1, 1), "Car", 95, 5, 100), (datetime.date(2023, 1, 1), "Motorcycles and Other", None, None, 10),
        (datetime.date(2023, 1, 1), "Tram", 4, 0, 4)))
    got = {(r["year"], r["vehicle_type"]): r for r in traffic.yearly_traffic_summary(imputed).collect()}
    car = got[(2023, "Car")]
    assert float(car["overall_non_compliant_pct"]) == 5.0
    assert car["absolute_change_vs_2022_polluters"] == 5 - 30          # against all types together
    assert car["absolute_change_vs_2022_clean"] == 95 - 90
    assert float(car["estimated_total_pollution_load"]) == 5 + 95 * 0.327
    assert float(got[(2023, "Motorcycles and Other")]["estimated_total_pollution_load"]) == 1.0
    assert got[(2023, "Motorcycles and Other")]["absolute_change_vs_2022_clean"] is None
    assert float(got[(2023, "Tram")]["estimated_total_pollution_load"]) == 2.0


def test_view_has_both_years(spark):
    view = traffic.traffic_view(traffic.impute_unrecognised(frame(spark, (datetime.date(2022, 3, 1), "Car", 1, 1, 2))))
    assert (view.first()["year"], view.first()["fiscal_year"]) == (2022, "2021/22")


def test_check_rule(spark):
    parts = [(None, None, 5), (2, 3, 5), (2, 3, 6), (None, 3, 5)]
    table = frame(spark, *[(JUNE, f"v{i}", *p) for i, p in enumerate(parts)])
    got = {r["rule"]: r["violations"] for r in rule_violations(table, "traffic", constraints.traffic_rules()).collect()}
    assert got["parts missing or sum to total"] == 1       # a NULL outcome passes
    assert got["date not null"] == 0


def test_stats_of_a_type_without_parts(spark):
    got = quality.traffic_stats(frame(spark, (JUNE, "Other", None, None, 10), (JUNE, "Other", None, None, 13))).first()
    assert got["median_compliant"] is None and got["median_total"] == 11.5
    assert got["median_compliance_rate_pct"] is None
