import numpy as np
import pytest
from pyspark.sql import functions as F

from airzone.functions import polygon, wkt
from airzone.functions.geodesy import with_bng
from airzone.operators import zones
from airzone.operators.simplify import kept_vertices
from airzone.plans import layers, tiers
from airzone.sources import dimensions

PLACES = {   # latitude, longitude -> tier number, metres
    "centre": (52.481789, -1.898739, "1", 0), "west": (52.486101, -1.986791, "4", 4759.01),
    "south-centre": (52.476824, -1.902129, "1", 0), "by the ring": (52.481346, -1.918235, "2", 141.29),
    "on the ring": (52.476145, -1.874978, "1", 0), "south-west": (52.44, -1.94, "4", 3645.82),
    "south-east": (52.459227, -1.871616, "3", 1207.36), "far north-east": (52.568194, -1.786267, "5", 10859.53)}


def places(spark, entries):
    return spark.createDataFrame([(k, *v) for k, v in entries.items()], "id string, latitude double, longitude double")


def test_projection_of_a_known_point(spark):
    """The Ordnance Survey's worked Caister water tower, given here in WGS84; 5 m accuracy."""
    got = with_bng(places(spark, {"x": (52.657977, 1.716052)})).first()
    assert abs(got["x_m"] - 651409.9) < 5 and abs(got["y_m"] - 313177.3) < 5


def test_missing_coordinates_project_to_null(spark):
    assert with_bng(places(spark, {"x": (None, 1.0)})).first()["x_m"] is None


def test_tiers_of_known_places(spark):
    got = {r["id"]: r for r in tiers.site_tiers(
        places(spark, {k: v[:2] for k, v in PLACES.items()}), dimensions.zone(spark)).collect()}
    for name, (_, _, number, metres) in PLACES.items():
        assert got[name]["caz_tier"].startswith(number), name
        assert float(got[name]["distance_to_caz_metres"]) == pytest.approx(metres, abs=5), name


def test_a_place_on_the_outline_straddles(spark):
    corner = places(spark, {"corner": (52.4883, -1.9168)})
    assert tiers.ward_tiers(corner, dimensions.zone(spark)).first()["caz_tier"] == "2. Close Boundary (Straddles CAZ)"
    assert tiers.site_tiers(corner, dimensions.zone(spark)).first()["caz_tier"] == "2. Close Boundary (<=500m)"


def test_a_hole_is_outside(spark):
    ring = "(-2 52, -1 52, -1 53, -2 53, -2 52)"
    hole = "(-1.6 52.4, -1.4 52.4, -1.4 52.6, -1.6 52.6, -1.6 52.4)"
    zone = dimensions.zone(spark, "z", f"POLYGON({ring},{hole})")
    got = {r["id"]: r["caz_tier"][0] for r in tiers.site_tiers(
        places(spark, {"in": (52.2, -1.5), "hole": (52.5, -1.5)}), zone).collect()}
    assert got["in"] == "1" and got["hole"] == "5"


def test_two_zones_are_refused(spark):
    both = dimensions.zone(spark).union(dimensions.zone(spark, "other"))
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        tiers.site_tiers(places(spark, {"x": (52.4, -1.9)}), both).collect()


def text(spark, value, column):
    return spark.createDataFrame([(value,)], "wkt string").select(column).first()[0]


@pytest.mark.parametrize("given, rounded", [
    ("POLYGON((0 0, 1.123456789 0, 1 1.000001, 0 0))", "POLYGON((0 0,1.12346 0,1 1,0 0))"),
    (" multipolygon ( ( (0 0 , 1 0, 1 1, 0 0) , (2 2,3 2,3 3,2 2) ) , ((-5 5,-6 5,-6 6,-5 5)) )",
     "MULTIPOLYGON(((0 0,1 0,1 1,0 0),(2 2,3 2,3 3,2 2)),((-5 5,-6 5,-6 6,-5 5)))"),
    ("POINT(-0.000004 100)", "POINT(0 100)"), ("POINT(10 1e-3)", "POINT(10 0.001)"),
    ("POLYGON EMPTY", None), (None, None)])
def test_rounded_text(spark, given, rounded):
    assert text(spark, given, layers.rounded_wkt(F.col("wkt"))) == rounded


def test_vertices_and_dimensions(spark, rows):
    frame = spark.createDataFrame([("a", "POLYGON((0 0,2 0,2 2,0 0),(1 1,1.5 1,1.5 1.5,1 1))")], "id string, wkt string")
    got = rows(wkt.vertices(frame, "id", "wkt"))
    assert len(got) == 8 and got[0] == ("a", 1, 1, 1, 0.0, 0.0) and got[-1] == ("a", 1, 2, 4, 1.0, 1.0)
    assert text(spark, "POLYGON((0 0 5,2 0 5,2 2 5,0 0 5))", wkt.dimensions_of(F.col("wkt"))) == 3


def test_point_text_keeps_precision(spark):
    frame = spark.range(1).select(layers.point_wkt(F.lit(-0.0001234567), F.lit(52.0)))
    assert frame.first()[0] == "POINT(-0.0001234567 52)"


def test_simplify(spark):
    def run(value, tolerance=0.1):
        return text(spark, value, layers.simplified_wkt(F.col("wkt"), tolerance))

    assert run("POLYGON((0 0, 5 0.05, 10 0, 10 10, 5 10.2, 0 10, 0 0))") == "POLYGON((0 0,10 0,10 10,5 10.2,0 10,0 0))"
    tiny = "(1 1,1.01 1,1.01 1.01,1 1)"
    assert run(f"POLYGON((0 0,10 0,10 10,0 0),{tiny})") == "POLYGON((0 0,10 0,10 10,0 0))"
    assert run(f"MULTIPOLYGON(({tiny}),((0 0,10 0,10 10,0 0)))") == "MULTIPOLYGON(((0 0,10 0,10 10,0 0)))"
    assert run(f"POLYGON({tiny})") is None and run(None) is None


def test_batched_simplification_equals_one_line_at_a_time():
    def plain(xs, ys, tolerance):
        """Textbook recursion."""
        def inner(lo, hi):
            best, at = -1.0, None
            for i in range(lo + 1, hi):
                ax, ay, bx, by = xs[lo], ys[lo], xs[hi], ys[hi]
                length2 = (bx - ax) ** 2 + (by - ay) ** 2
                t = min(1, max(0, ((xs[i] - ax) * (bx - ax) + (ys[i] - ay) * (by - ay)) / length2)) if length2 else 0
                gap = (xs[i] - ax - t * (bx - ax)) ** 2 + (ys[i] - ay - t * (by - ay)) ** 2
                if gap > best:
                    best, at = gap, i
            return inner(lo, at) | {at} | inner(at, hi) if at is not None and best > tolerance ** 2 else set()
        return {0, len(xs) - 1} | inner(0, len(xs) - 1)

    rng = np.random.default_rng(3)
    sizes = [1, 2, 3, 4, 40, 300, 5]
    xs, ys = rng.normal(0, 1, sum(sizes)).cumsum(), rng.normal(0, 1, sum(sizes)).cumsum()
    ends = np.cumsum(sizes)
    keep = kept_vertices(xs, ys, ends - sizes, ends, 1.5)
    for start, end in zip(ends - sizes, ends):
        assert set(np.flatnonzero(keep[start:end])) == plain(xs[start:end], ys[start:end], 1.5)


def test_map_layers_pad_missing_columns(spark):
    outlines = spark.createDataFrame(
        [("1. Inside CAZ", "Core", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)))"), ("5. Outer", "Rest", None)],
        "caz_tier string, tier_description string, wkt string")
    wards = spark.createDataFrame([("W1", "Ward", 52.4, -1.9)], "area_code string, area_name string, latitude double, longitude double")
    boundaries = spark.createDataFrame([("W9", "POLYGON((0 0,1 0,1 1,0 0))")], "wd23cd string, wkt string")
    dim = layers.dim_wards(tiers.ward_tiers(wards, dimensions.zone(spark)), boundaries)
    assert dim.first()["wkt_geometry"] is None                       # a ward without outline stays
    got = {r["map_id"]: r for r in layers.map_layer_wards(outlines, dim).collect()}
    assert got["1. Inside CAZ"]["map_label"] == "CAZ Tier 1. Inside CAZ" and got["1. Inside CAZ"]["area_code"] is None
    assert got["W1"]["layer_type"] == "Ward Boundary" and got["5. Outer"]["wkt_geometry"] is None


def square(x, y, size, hole=None):
    ring = lambda a, b, s: f"({a} {b}, {a + s} {b}, {a + s} {b + s}, {a} {b + s}, {a} {b})"
    return ring(x, y, size) + (f", {ring(*hole)}" if hole else "")


ZONES = {"small": f"POLYGON({square(-1.9, 52.4, 0.01)})", "huge": f"POLYGON({square(-4.0, 50.5, 3.5)})",
         "holed": f"POLYGON({square(-1.95, 52.35, 0.1, (-1.91, 52.39, 0.03))})",
         "parts": f"MULTIPOLYGON(({square(-1.9, 52.4, 0.004)}), ({square(0.5, 51.0, 0.2)}))", "empty": "POLYGON EMPTY", "none": None}


@pytest.mark.parametrize("broadcast", [True, False])
def test_zones_of_points_match_each_zone_alone(spark, broadcast, no_broadcast):
    if not broadcast:
        no_broadcast()
    rng = np.random.default_rng(5)
    spots = [(float(a), float(b)) for a, b in zip(rng.uniform(-1.96, -1.84, 150), rng.uniform(52.34, 52.46, 150))]
    spots += [(-1.9, 52.4), (0.6, 51.1), (-3.0, 51.0), (5.0, 60.0), (None, 52.0), (-1.9, None), (-1.905, 52.395)]
    points = spark.createDataFrame([(i, lon, lat, "x") for i, (lon, lat) in enumerate(spots)], "id int, longitude double, latitude double, level string")
    zones_df = spark.createDataFrame(list(ZONES.items()), "name string, wkt string")
    got = zones.zones_of(points, zones_df, "name")
    assert got.columns == ["id", "longitude", "latitude", "level", "name", "on_edge"]
    want = set()
    for name, text in ZONES.items():
        if text and "(" in text:
            alone = tiers.ward_tiers(points, dimensions.zone(spark, name, text)).collect()
            want |= {(r.id, name) for r in alone if r.caz_tier[:1] == "1" or "Straddles" in r.caz_tier}
    found = [(r.id, r.name) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == want and len({n for _, n in found}) == 4
    assert {r.name for r in got.filter("on_edge").collect()} == {"small", "parts"}
    assert zones.zones_of(points.limit(0), zones_df, "name").count() == 0 and zones.zones_of(points, zones_df.limit(0), "name").count() == 0


def test_a_zone_of_any_size_has_few_cells_and_no_nested_loop(spark):
    frame = spark.createDataFrame(list(ZONES.items()), "name string, wkt string")
    cells = zones.zone_cells(polygon.zone_edges(frame, "name"), "name")
    assert max(r["count"] for r in cells.groupBy("name").count().collect()) <= (zones.ACROSS + 2) ** 2
    points = spark.createDataFrame([(1, -1.9, 52.4)], "id int, longitude double, latitude double")
    plan = zones.zones_of(points, frame, "name")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_malformed_outlines_become_null_and_are_listed(spark):
    texts = {"words": "POLYGON((a b, c d, e f, a b))", "vast": "POLYGON((1e30 1, 2 2, 3 1, 1e30 1))", "short": "POLYGON((1, 2 2, 3 1, 1))", "nan": "POLYGON((NaN 1, 2 2, 3 1, NaN 1))",
             "good": "POLYGON((1.234567 1, 2 2, 3 1, 1.234567 1))", "empty": "POLYGON EMPTY", "null": None}
    frame = spark.createDataFrame(list(texts.items()), "name string, wkt string")
    assert {r.name for r in tiers.malformed_outlines(frame, "name", "wkt").collect()} >= {"words", "vast", "nan"}
    shown = {r.name: r.w for r in frame.select("name", layers.rounded_wkt(F.col("wkt"), 4).alias("w")).collect()}
    assert shown["good"].startswith("POLYGON((1.2346 1,") and not any(shown[n] for n in ("words", "vast", "nan", "empty", "null"))
    assert {r.name for r in wkt.vertices(frame, "name", "wkt").collect()} - {"short"} == {"good"}
    point = spark.createDataFrame([(1, 2.0, 1.5)], "id int, longitude double, latitude double")
    assert "good" in {r.name for r in zones.zones_of(point, frame, "name").collect()}


def test_points_at_one_spot_are_judged_together(spark):
    """Their other columns, and the points themselves, meet the zones of their spot after the edges were looked at."""
    frame = spark.createDataFrame(list(ZONES.items()), "name string, wkt string")
    points = spark.createDataFrame([(i, -1.905, 52.395, "x" * 50) for i in range(40)] + [(40, -1.905, 52.395, None)] * 2,
                                   "id int, longitude double, latitude double, note string")
    got = zones.zones_of(points, frame, "name")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    judged = plan[plan.index("exists("):]
    assert "Aggregate [_lon" in judged and "note" not in judged.split("Aggregate [_lon")[0]
    assert sorted((r.id, r.name, r.on_edge) for r in got.collect()) == sorted(
        (i, n, False) for i in [*range(40), 40, 40] for n in {r.name for r in got.collect()})


def test_an_outline_is_read_where_it_was_dealt_to(spark):
    """Text of a few megabytes comes in one file split, but its vertices are long work."""
    frame = spark.createDataFrame([(i, f"POLYGON({square(-1.9, 52.4, 0.01)})") for i in range(64)], "id long, wkt string").coalesce(1)
    points = spark.createDataFrame([(1, -1.905, 52.395)], "id int, longitude double, latitude double")
    seen = []
    real, zones.stage = zones.stage, lambda df, name: seen.append(df) or real(df, name)
    try:
        zones.zones_of(points, frame.withColumnRenamed("id", "zone"), "zone")
    finally:
        zones.stage = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(zone")
    assert plan.count("Exchange") == 1 and "Generate" in plan[:exchange] and "Generate" not in plan[exchange:]
