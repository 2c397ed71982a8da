import numpy as np
import pytest

from airzone.operators import nearest
from airzone.operators.nearest import nearest_place
from airzone.plans import annual


def brute(points, places):
    best = {}
    for g, x, y in set(points):
        found = [((x - px) ** 2 + (y - py) ** 2, i) for pg, i, px, py in places if pg == g]
        if found:
            best[(g, x, y)] = min(found)[1]
    return best


def scattered(rng, n, spread):
    centre = rng.uniform(-60, 60, 2)
    return [(float(round(centre[0] + rng.normal(0, spread), 6)), float(round(centre[1] + rng.normal(0, spread), 6)))
            for _ in range(n)]


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("options", [{}, {"leaf_limit": 8}, {"root_cell": 1.0, "leaf_limit": 2}])
def test_any_pyramid_matches_brute_force(spark, options, broadcast, no_broadcast):
    if not broadcast:
        no_broadcast()
    rng = np.random.default_rng(11)
    # Dense clusters, loners far from them, repeated spots and points on top of places.
    spots = scattered(rng, 60, 0.01) + scattered(rng, 40, 3.0) + scattered(rng, 5, 40.0)
    places = [(2000 + i % 2, i, x, y) for i, (x, y) in enumerate(
        scattered(rng, 120, 0.005) + scattered(rng, 60, 5.0) + spots[:10] + spots[:10])]
    points = [(g, x, y) for g in (2000, 2001, 2002) for x, y in spots]
    got = nearest_place(spark.createDataFrame(points + points[:30], "g int, x double, y double"),
                        spark.createDataFrame(places, "g int, id int, x double, y double"), "g", "id", **options)
    assert {(r["g"], r["x"], r["y"]): r["id"] for r in got.collect()} == brute(points, places)


def site_years(spark, entries):
    months = [10.0] * 12
    return spark.createDataFrame(
        [(s, y, 12, v, 10.0, months) for s, y, v in entries],
        "site_id string, reading_year int, total_monitored_months long, valid_months_count long,"
        " raw_direct_mean double, month_means array<double>")


SITES = "site_id string, site_name string, site_type string, latitude double, longitude double"


def test_reference_rules(spark, rows):
    sites = spark.createDataFrame([
        ("t", "target", "ROADSIDE", 52.0, -1.90), ("near", "n", "roadside", 52.0, -1.90),
        ("far", "f", "Background", 52.0, -1.50), ("b2", "b", "BACKGROUND", 52.1, -1.90),
        ("b1", "b", "background", 51.9, -1.90)], SITES)
    years = site_years(spark, [
        ("t", 2020, 5), ("near", 2020, 12), ("far", 2020, 9), ("b1", 2020, 8), ("b2", 2020, 9),   # b1 needs help too
        ("t", 2021, 2), ("b2", 2021, 12),                                                         # too little to annualise
        ("t", 2022, 3), ("near", 2022, 12)])                                                      # no background site
    assert rows(annual.nearest_reference(years, sites)) == [("b1", 2020, "b2"), ("t", 2020, "b2")]


def test_ties_and_missing_coordinates(spark, rows):
    sites = spark.createDataFrame([
        ("t", "t", "ROADSIDE", 50.0, 0.0), ("u", "u", "ROADSIDE", None, 0.0),
        ("w", "w", "BACKGROUND", 50.0, 1.0), ("e", "e", "BACKGROUND", 50.0, -1.0)], SITES)
    years = site_years(spark, [("t", 2020, 8), ("u", 2020, 3), ("w", 2020, 9), ("e", 2020, 9)])
    assert rows(annual.nearest_reference(years, sites)) == [("t", 2020, "e"), ("u", 2020, "e")]


def test_metric_changes_the_answer(spark, rows):
    """A degree of longitude is much shorter than one of latitude."""
    sites = spark.createDataFrame([
        ("t", "t", "ROADSIDE", 52.0, -2.0), ("east", "e", "BACKGROUND", 52.0, -1.88),
        ("north", "n", "BACKGROUND", 52.1, -2.0)], SITES)
    years = site_years(spark, [("t", 2020, 5), ("east", 2020, 9), ("north", 2020, 9)])
    assert rows(annual.nearest_reference(years, sites)) == [("t", 2020, "north")]
    for options in ({}, {"leaf_limit": 1, "root_cell": 4096.0}):
        assert rows(annual.nearest_reference(years, sites, metric="bng", **options)) == [("t", 2020, "east")]


def test_cells_exist_below_crowded_ones_only(spark):
    rng = np.random.default_rng(2)
    spots = scattered(rng, 200, 0.01) + scattered(rng, 5, 20.0)
    stops = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(spots)], "_g int, _id int, _px double, _py double")
    cells = nearest._pyramid(stops, 64.0, 16).collect()
    held = lambda c: sum(np.floor(x / 64 * 8 ** c["_level"]) == c["_cx"] and np.floor(y / 64 * 8 ** c["_level"]) == c["_cy"] for x, y in spots)
    size = {(c["_level"], c["_cx"], c["_cy"]): held(c) for c in cells}
    assert all(c["_leaf"] == (size[c["_level"], c["_cx"], c["_cy"]] <= 16) for c in cells)
    assert all(size[c["_level"] - 1, c["_ux"], c["_uy"]] > 16 for c in cells if c["_level"])
    assert sum(size[c["_level"], c["_cx"], c["_cy"]] for c in cells if c["_leaf"]) == len(spots)


def test_nothing_is_sorted_while_points_descend(spark):
    """A point meets many cells and places on its way; a sort or window over them held them all in one task."""
    rng = np.random.default_rng(3)
    spots = [(1, i, x, y) for i, (x, y) in enumerate(scattered(rng, 300, 0.01))]
    frame = spark.createDataFrame(spots, "g int, id long, x double, y double")
    found = nearest_place(frame, frame, "g", "id", leaf_limit=4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SortAggregate" not in plan
    assert {(r["x"], r["y"]): r["id"] for r in found.collect()} == {(x, y): i for _, i, x, y in spots}


def test_coordinates_that_are_no_numbers_hide_no_place(spark):
    nan = float("nan")
    places = spark.createDataFrame([(1, 7, nan, 1.0), (1, 8, 2.0, 1.0), (2, 9, nan, nan)], "g int, id long, x double, y double")
    points = spark.createDataFrame([(1, 0.5, 1.0), (1, nan, 1.0), (2, 0.0, 0.0)], "g int, x double, y double")
    got = nearest_place(points, places, "g", "id").collect()
    assert sorted((r["g"], repr(r["x"]), r["id"]) for r in got) == [(1, "0.5", 8), (1, "nan", 7), (2, "0.0", 9)]
