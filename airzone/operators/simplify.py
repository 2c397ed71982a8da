"""Douglas-Peucker vertex reduction of a geometry column."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from airzone.functions.wkt import GEOMETRY_TYPE

MIN_RING = 4      # a closed triangle


def kept_vertices(xs: np.ndarray, ys: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                  tolerance: float) -> np.ndarray:
    """Mask of the vertices that stay in each line ``starts[i]:ends[i]``.

    Every round looks at all open chords of the batch at once: a chord whose
    farthest vertex (the first, on ties) lies beyond ``tolerance`` is split there.
    """
    keep = np.zeros(len(xs), dtype=bool)
    keep[starts], keep[ends - 1] = True, True
    lo, hi = starts, ends - 1
    while True:
        open_ = hi - lo >= 2
        lo, hi = lo[open_], hi[open_]
        if not len(lo):
            return keep
        inner = hi - lo - 1
        first = np.cumsum(inner) - inner
        chord = np.repeat(np.arange(len(lo)), inner)
        at = np.arange(len(chord)) - first[chord] + lo[chord] + 1

        dx, dy = (xs[hi] - xs[lo])[chord], (ys[hi] - ys[lo])[chord]
        px, py = xs[at] - xs[lo][chord], ys[at] - ys[lo][chord]
        length2 = dx * dx + dy * dy
        along = np.clip((px * dx + py * dy) / np.where(length2 > 0, length2, 1.0), 0.0, 1.0)
        gap2 = (px - along * dx) ** 2 + (py - along * dy) ** 2

        farthest = np.maximum.reduceat(gap2, first)
        hits = np.flatnonzero(gap2 == farthest[chord])
        split_at = at[hits[np.unique(chord[hits], return_index=True)[1]]]
        split = farthest > tolerance * tolerance
        keep[split_at[split]] = True
        lo, hi = np.r_[lo[split], split_at[split]], np.r_[split_at[split], hi[split]]


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)


def _sums(flags: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Number of set flags in each consecutive run."""
    running = np.r_[0, np.cumsum(flags)]
    ends = np.cumsum(sizes)
    return running[ends] - running[ends - sizes]


def _lists(sizes: np.ndarray, values: pa.Array, nulls: np.ndarray | None = None) -> pa.Array:
    offsets = pa.array(np.r_[0, np.cumsum(sizes)], pa.int32())
    return pa.ListArray.from_arrays(offsets, values, mask=None if nulls is None else pa.array(nulls))


def simplify(geometry: Column, tolerance: float) -> Column:
    """Drop vertices within ``tolerance`` of the simplified outline of each polygon.

    Rings stay closed. A hole that falls below four vertices goes; so does a part
    whose outer ring does, and a geometry without parts becomes NULL.
    """
    @F.arrow_udf(GEOMETRY_TYPE)
    def run(column: pa.Array) -> pa.Array:
        parts = column.flatten()
        rings = parts.flatten()
        ring_xs, ring_ys = rings.flatten()
        part_count, ring_count, point_count = _sizes(column), _sizes(parts), _sizes(ring_xs)
        xs, ys = ring_xs.flatten().to_numpy(), ring_ys.flatten().to_numpy()
        ends = np.cumsum(point_count)
        keep = kept_vertices(xs, ys, ends - point_count, ends, tolerance)

        ring_kept = _sums(keep, point_count)
        outer = np.cumsum(ring_count) - ring_count
        part_stays = ring_kept[outer] >= MIN_RING
        ring_stays = (ring_kept >= MIN_RING) & np.repeat(part_stays, ring_count)
        keep &= np.repeat(ring_stays, point_count)

        points = ring_kept[ring_stays]
        lines = pa.StructArray.from_arrays(
            [_lists(points, pa.array(xs[keep])), _lists(points, pa.array(ys[keep]))], ["xs", "ys"])
        polygons = _lists(_sums(ring_stays, ring_count)[part_stays], lines)
        remaining = _sums(part_stays, part_count)
        return _lists(remaining, polygons, nulls=remaining == 0)

    return run(geometry)
