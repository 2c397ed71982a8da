"""Well-known text as a column: text <-> nested rings, without a shuffle.

A geometry is an array of parts; a part is an array of rings; a ring holds the
coordinate arrays ``xs`` and ``ys``. Points use a single one-vertex ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RING_TYPE = "struct<xs:array<double>,ys:array<double>>"
#: Ordinates from here on are not coordinates, and would not fit the decimals they are written with.
LARGEST = 1e15
GEOMETRY_TYPE = f"array<array<{RING_TYPE}>>"


def kind_of(wkt: Column) -> Column:
    """Upper-case type word, such as POLYGON."""
    return F.upper(F.regexp_extract(wkt, r"^\s*([A-Za-z]+)", 1))


def _compact_body(wkt: Column) -> Column:
    bare = F.regexp_replace(wkt, r"^\s*[A-Za-z]+\s*", "")
    return F.regexp_replace(F.regexp_replace(F.trim(bare), r"\s+", " "), " ?([(),]) ?", "$1")


def dimensions_of(wkt: Column) -> Column:
    """Number of ordinates of the first vertex."""
    first = F.regexp_extract(_compact_body(wkt), r"^\(+([^(),]*)", 1)
    return F.size(F.split(first, " "))


def _ring(text: Column) -> Column:
    vertices = F.split(text, ",")
    x = F.transform(vertices, lambda v: F.substring_index(v, " ", 1).try_cast("double"))
    y = F.transform(vertices, lambda v: F.substring_index(F.substring_index(v, " ", 2), " ", -1).try_cast("double"))
    return F.struct(x.alias("xs"), y.alias("ys"))


def parse_wkt(wkt: Column) -> Column:
    """Points, polygons and multipolygons to nested rings; NULL for NULL, EMPTY and text with a vertex that is no pair of
    numbers below ``LARGEST``."""
    inner = F.regexp_replace(_compact_body(wkt), r"^\(+|\)+$", "")
    parts = F.transform(
        F.split(inner, r"\)\),\(\("),
        lambda part: F.transform(F.split(part, r"\),\("), _ring))
    sound = lambda v: F.coalesce(F.abs(v) < LARGEST, F.lit(False))
    return F.when(wkt.rlike(r"\("), F.transform(F.array(parts), lambda g: F.when(
        F.forall(F.flatten(g), lambda ring: F.forall(F.concat(ring["xs"], ring["ys"]), sound)), g))[0])


def malformed(wkt: Column) -> Column:
    """Whether text holds vertices but cannot be read."""
    return wkt.rlike(r"\(") & parse_wkt(wkt).isNull()


def number_text(value: Column, digits: int) -> Column:
    """Rounded decimal text without trailing zeros or exponent."""
    fixed = F.round(value.cast(f"decimal(28,{max(digits, 10)})"), digits).cast("string")
    return F.rtrim(F.rtrim(fixed, F.lit("0")), F.lit("."))     # digits > 0, so a point is there


def to_wkt(geometry: Column, kind: Column, digits: int) -> Column:
    """Text of nested rings with rounded coordinates."""
    def ring_text(ring: Column) -> Column:
        return F.array_join(F.zip_with(
            ring["xs"], ring["ys"],
            lambda x, y: F.concat(number_text(x, digits), F.lit(" "), number_text(y, digits))), ",")

    parts = F.array_join(F.transform(
        geometry,
        lambda part: F.array_join(F.transform(part, ring_text), "),(")), ")),((")
    depth = (F.when(kind == "POINT", 1).when(kind == "POLYGON", 2).otherwise(3))
    return F.concat(kind, F.repeat(F.lit("("), depth), parts, F.repeat(F.lit(")"), depth))


def vertices(df: DataFrame, key: str, wkt: str) -> DataFrame:
    """One row per vertex: key, part, ring, seq (all from 1), x, y."""
    parts = df.select(F.col(key), F.posexplode(parse_wkt(F.col(wkt))).alias("part", "_rings"))
    rings = parts.select(key, "part", F.posexplode("_rings").alias("ring", "_points"))
    points = rings.select(
        key, "part", "ring",
        F.posexplode(F.arrays_zip(F.col("_points.xs"), F.col("_points.ys"))).alias("seq", "_v"))
    return points.select(
        key, (F.col("part") + 1).alias("part"), (F.col("ring") + 1).alias("ring"),
        (F.col("seq") + 1).alias("seq"), F.col("_v.xs").alias("x"), F.col("_v.ys").alias("y"))
