"""Exact nearest place for every point, within groups such as years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from airzone.sources.tables import stage

LEAF_LIMIT = 64           # places up to which a grid cell is not divided again
FANOUT = 8                # grid refinement per axis and level
MAX_DEPTH = 10            # cells of the last level are never divided
SPOT = ["_g", "_x", "_y"]


def _square(c: Column) -> Column:
    return c * c


def nearest_place(points: DataFrame, places: DataFrame, group: str, place_id: str, *,
                  x: str = "x", y: str = "y", root_cell: float = 64.0, leaf_limit: int = LEAF_LIMIT) -> DataFrame:
    """Distinct (group, x, y) of ``points`` with the closest ``place_id``; smallest id on ties.

    Points and places at one spot are merged first, so crowded spots count once. A pyramid of grid cells is made of
    the places and stored: one aggregation counts the cells of all levels, and cells exist only below crowded ones.
    Points descend it twice, dropping the cells that cannot hold the nearest place: first within a distance known from
    the cells about them, for the least distance, then within that, for the id. Only sums of their own rows leave a task,
    nothing is sorted while it is multiplied. ``root_cell`` is so large (64 degrees, or 1,000 km) that a group has only the
    handful its extent covers.
    """
    spots = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        F.col(group).alias("_g"), F.col(x).alias("_x"), F.col(y).alias("_y")).distinct()
    stops = (places.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
             .groupBy(F.col(group).alias("_g"), F.col(x).alias("_px"), F.col(y).alias("_py"))
             .agg(F.min(place_id).alias("_id")))
    return _search(spots, stage(stops, "places"), root_cell, leaf_limit).select(
        F.col("_g").alias(group), F.col("_x").alias(x), F.col("_y").alias(y), F.col("_id").alias(place_id))


def _cell_size(level: Column, root_cell: float) -> Column:
    return F.lit(root_cell) / F.pow(F.lit(float(FANOUT)), level)      # powers of two: cells nest exactly


def _on_levels(stops: DataFrame, deepest: int, root_cell: float) -> DataFrame:
    """Every place with its cell on each level."""
    size = _cell_size(F.col("_level"), root_cell)
    return stops.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(deepest)))).withColumns(
        {"_cx": F.floor(F.col("_px") / size), "_cy": F.floor(F.col("_py") / size)})


def _parent(cell: Column) -> Column:
    """Cells of the first level have one parent, 0."""
    return F.when(F.col("_level") == 0, F.lit(0).cast("long")).otherwise(cell)


def _pyramid(stops: DataFrame, root_cell: float, leaf_limit: int) -> DataFrame:
    """Occupied cells of the first level and below crowded cells, with the box of their places; ``_leaf`` ones are not divided."""
    box = [f(f"_p{a}").alias(f"_{a}{end}") for a in "xy" for f, end in ((F.min, "1"), (F.max, "2"))]
    counted = (_on_levels(stops, MAX_DEPTH, root_cell).groupBy("_g", "_level", "_cx", "_cy").agg(F.count(F.lit(1)).alias("_n"), *box)
               .withColumns({f"_u{a}": _parent(F.floor(F.col(f"_c{a}") / FANOUT)) for a in "xy"}))
    # a parent has at most FANOUT squared cells, which bounds the window
    around = F.sum("_n").over(Window.partitionBy("_g", "_level", "_ux", "_uy"))
    return (counted.withColumn("_around", around).filter((F.col("_level") == 0) | (F.col("_around") > leaf_limit))
            .withColumn("_leaf", (F.col("_n") <= leaf_limit) | (F.col("_level") == MAX_DEPTH)).drop("_n", "_around"))


def _sides(axis: str) -> tuple[Column, Column, Column]:
    """Along an axis, the distance of a spot to a cell's box, to the nearer and to the farther of its two sides."""
    at, low, high = F.col(f"_{axis}"), F.col(f"_{axis}1"), F.col(f"_{axis}2")
    return F.greatest(low - at, at - high, F.lit(0.0)), F.least(F.abs(at - low), F.abs(at - high)), F.greatest(F.abs(at - low), F.abs(at - high))


def _bounds(spots: DataFrame, cells: DataFrame, depth: int, root_cell: float) -> DataFrame:
    """Spots with a squared distance, ``_bound``, within which they have a place.

    Every side of a cell's box holds a place, which is no farther than that side's far end. Cells looked at are those of
    the first level and the siblings of the spot's own cell on every other.
    """
    (_, near_x, far_x), (_, near_y, far_y) = _sides("x"), _sides("y")
    reach = F.least(_square(near_x) + _square(far_y), _square(far_x) + _square(near_y))
    above = _cell_size(F.col("_level") - 1, root_cell)
    own = spots.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumns(
        {f"_u{a}": _parent(F.floor(F.col(f"_{a}") / above)) for a in "xy"})
    return own.join(cells, ["_g", "_level", "_ux", "_uy"]).groupBy(*SPOT).agg(F.min(reach).alias("_bound"))


def _within(bounded: DataFrame, stops: DataFrame, cells: DataFrame, depth: int, root_cell: float) -> DataFrame:
    """(spot, ``_d2``, ``_id``) of the places within the spots' ``_bound``.

    Every step replaces the crowded cells of a level by their children. Differences, squares and sums keep their order
    when they are rounded, so a cell is never farther than its places. NaN drops nothing.
    """
    distance = F.nanvl(_square(_sides("x")[0]) + _square(_sides("y")[0]), F.lit(0.0))
    found = bounded.withColumns({"_level": F.lit(-1), "_cx": F.lit(0).cast("long"), "_cy": F.lit(0).cast("long")})
    for level in range(depth + 1):
        children = cells.filter(F.col("_level") == level).select(
            "_g", (F.col("_level") - 1).alias("_level"), F.col("_ux").alias("_cx"), F.col("_uy").alias("_cy"),
            F.struct("_level", "_cx", "_cy").alias("_child"), "_x1", "_x2", "_y1", "_y2")
        found = (found.join(children, ["_g", "_level", "_cx", "_cy"], "left")
                 .filter(F.col("_child").isNull() | (distance <= F.col("_bound")))
                 .select(*SPOT, "_bound", *[F.coalesce(F.col("_child")[n], n).alias(n) for n in ("_level", "_cx", "_cy")]))
    d2 = _square(F.col("_x") - F.col("_px")) + _square(F.col("_y") - F.col("_py"))
    return (found.join(_on_levels(stops, depth, root_cell), ["_g", "_level", "_cx", "_cy"])
            .select(*SPOT, "_bound", "_id", d2.alias("_d2")).filter("_d2 <= _bound"))


def _search(spots: DataFrame, stops: DataFrame, root_cell: float, leaf_limit: int) -> DataFrame:
    """Branch and bound over the pyramid, coarse to fine.

    The depth of the stored pyramid is the one number that reaches the driver. The joins are left to Catalyst, which
    sees the true size of the cells when it runs them.
    """
    cells = stage(_pyramid(stops, root_cell, leaf_limit), "cells")
    depth = cells.agg(F.coalesce(F.max("_level"), F.lit(0))).first()[0]
    rough = _bounds(spots, cells, depth, root_cell)
    least = stage(_within(rough, stops, cells, depth, root_cell).groupBy(*SPOT).agg(F.min("_d2").alias("_bound")), "least-distances")
    return _within(least, stops, cells, depth, root_cell).groupBy(*SPOT).agg(F.min("_id").alias("_id"))
