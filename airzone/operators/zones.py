"""Points against many outlines: an equi-join on grid cells, then the edges.

Cells have sides of powers of two metres. An outline's level is the one on which its box covers a few cells, however
large it is; a point has one cell on every level in use. So neither side multiplies with the size of an outline, and
a point meets an outline at most once. Points at one spot are judged together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from airzone.functions.geodesy import with_bng
from airzone.functions.polygon import EDGE_METRES, held_by, zone_edges
from airzone.sources.tables import stage

ACROSS = 4      # cells that an outline's box may span per axis, besides the one it begins in


def zone_cells(outlines: DataFrame, key: str) -> DataFrame:
    """(key, level, cx, cy) of the cells that the box of each row's ``edges`` touches, and the box itself."""
    def bound(best: str, pick: str, axis: str, widen: str) -> str:
        return f"array_{best}(transform(edges, e -> {pick}(e.{axis}1, e.{axis}2))) {widen} {2 * EDGE_METRES!r}D"

    box = outlines.filter(F.size("edges") > 0).select(key, *[
        F.expr(bound(best, pick, axis, widen)).alias(f"{axis}_{best}")
        for axis in "xy" for best, pick, widen in (("min", "least", "-"), ("max", "greatest", "+"))])
    span = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min"))
    leveled = box.withColumn("level", F.greatest(F.ceil(F.log2(span / ACROSS)), F.lit(0)).cast("int"))
    for axis in "xy":
        leveled = leveled.withColumn(f"c{axis}", F.explode(F.expr(
            f"sequence(floor({axis}_min / pow(2D, level)), floor({axis}_max / pow(2D, level)))")))
    return leveled


def zones_of(points: DataFrame, zones: DataFrame, key: str, wkt: str = "wkt", *,
             longitude: str = "longitude", latitude: str = "latitude") -> DataFrame:
    """``points`` with the ``key`` of every zone that holds them and ``on_edge``; a point in several zones has several rows.

    Zones are rows of well-known text. Points without coordinates, and zones without an outline, match nothing. The
    join on cells and the one that brings a candidate its edges are plain equi-joins: Catalyst may broadcast either
    side by its true size and splits a crowded cell or zone. Spots go through them, without the other columns; the points
    meet the zones of their spot at the end.
    """
    # a few megabytes of text are long work: they are dealt out first, by key, so that vertices need no other exchange
    outlines = stage(zone_edges(zones.select(key, wkt).repartition(key), key, wkt), "outlines")
    cells = stage(zone_cells(outlines, key), "zone-cells")
    # the levels in use are powers of two from a metre to the size of the earth, two dozen values at most
    used = cells.select(F.collect_set("level").alias("levels")).scalar()
    located = points.withColumn("_p", F.struct(*points.columns)).select("_p", F.col(longitude).alias("_lon"), F.col(latitude).alias("_lat"))
    spots = located.select("_lon", "_lat").distinct()
    placed = (with_bng(spots, "_lon", "_lat", "_x", "_y").filter("_x IS NOT NULL AND _y IS NOT NULL")
              .select("_lon", "_lat", "_x", "_y", F.explode(used).alias("level"))
              .withColumns({f"c{a}": F.expr(f"floor(_{a} / pow(2D, level))") for a in "xy"}))
    near = (placed.join(cells, ["level", "cx", "cy"]).filter("_x BETWEEN x_min AND x_max AND _y BETWEEN y_min AND y_max")
            .select("_lon", "_lat", "_x", "_y", F.col(key).alias("_zone")))
    judged = (near.join(outlines.withColumnRenamed(key, "_zone"), "_zone").withColumn("_at", held_by("edges", "_x", "_y"))
              .filter("_at.inside OR _at.on_edge").select("_lon", "_lat", "_zone", "_at.on_edge"))
    return located.join(judged, ["_lon", "_lat"]).select("_p.*", F.col("_zone").alias(key), "on_edge")
