"""Point against polygon, as expressions over an array of edges.

An edge is ``struct<x1,y1,x2,y2>`` in planar metres. Holes and several parts
need no special case: crossings are counted over all edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airzone.functions.binding import bind, named_values
from airzone.functions.geodesy import bng_levels, with_bng
from airzone.functions.wkt import vertices

EDGE_METRES = 1e-6     # closer than this to an edge counts as on it


def zone_edges(zone: DataFrame, key: str = "name", wkt: str = "wkt") -> DataFrame:
    """Projected edges of each zone, one row per zone.

    The collected group is one text value's own vertices, so its size is that
    of a single input row.
    """
    corner = F.struct("part", "ring", "seq", "x_m", "y_m")
    outline = (with_bng(vertices(zone, key, wkt), "x", "y")
               .groupBy(key).agg(F.sort_array(F.collect_list(corner)).alias("_v")))
    pairs = F.expr("""zip_with(_v, slice(_v, 2, size(_v)), (a, b) ->
        if(a.part = b.part and a.ring = b.ring,
           named_struct('x1', a.x_m, 'y1', a.y_m, 'x2', b.x_m, 'y2', b.y_m), null))""")
    return outline.select(key, F.array_compact(pairs).alias("edges"))


# Where along an edge the foot of the perpendicular falls, clamped to the edge.
_FOOT = """greatest(0D, least(1D, try_divide(
    (at.x - e.x1)*(e.x2 - e.x1) + (at.y - e.y1)*(e.y2 - e.y1),
    (e.x2 - e.x1)*(e.x2 - e.x1) + (e.y2 - e.y1)*(e.y2 - e.y1))))"""
_GAP = bind({"foot": {"t": _FOOT}},
            "hypot(at.x - e.x1 - foot.t*(e.x2 - e.x1), at.y - e.y1 - foot.t*(e.y2 - e.y1))")
# The point is in the edge's box, which is widened beyond rounding.
_BESIDE = " and ".join(f"at.{a} between least(e.{a}1, e.{a}2) - {2 * EDGE_METRES!r} and greatest(e.{a}1, e.{a}2) + {2 * EDGE_METRES!r}"
                       for a in "xy")
# A ray to the right of the point meets the edge.
_MEETS = """((e.y1 > at.y) != (e.y2 > at.y)
    and at.x < try_divide((e.x2 - e.x1)*(at.y - e.y1), e.y2 - e.y1) + e.x1)"""


def position_of(edges: str, x: str, y: str) -> Column:
    """Struct ``inside``, ``on_edge``, ``distance`` of a planar point; distance is 0 within the outline."""
    return F.expr(_position({"at": {"x": x, "y": y}}, edges))


def held_by(edges: str, x: str, y: str) -> Column:
    """``inside`` and ``on_edge`` of ``position_of``; the distance is worked out for edges whose box is that close only."""
    return F.expr(bind({"at": {"x": x, "y": y}, "near": {"on_edge": f"exists({edges}, e -> {_BESIDE} and {_GAP} <= {EDGE_METRES!r})",
                                                         "odd": f"size(filter({edges}, e -> {_MEETS})) % 2 = 1"}},
                       named_values({"inside": "near.odd and not near.on_edge", "on_edge": "near.on_edge"})))


def position_in(edges: str, longitude: str = "longitude", latitude: str = "latitude") -> Column:
    """``position_of`` a point in degrees, projected."""
    return F.expr(_position(bng_levels(longitude, latitude), edges))


def _position(levels: dict[str, dict[str, str]], edges: str) -> str:
    levels = {**levels, "near": {"gap": f"array_min(transform({edges}, e -> {_GAP}))",
                                 "odd": f"size(filter({edges}, e -> {_MEETS})) % 2 = 1"}}
    return bind(levels, named_values({
        "inside": f"near.odd and near.gap > {EDGE_METRES!r}",
        "on_edge": f"near.gap <= {EDGE_METRES!r}",
        "distance": "if(near.odd, 0D, near.gap)"}))
