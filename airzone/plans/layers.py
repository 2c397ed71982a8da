"""Ward dimension and map layers for a reporting tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airzone import constants as C
from airzone.functions.wkt import kind_of, number_text, parse_wkt, to_wkt
from airzone.operators.simplify import simplify


def ward_boundary_view(boundaries: DataFrame) -> DataFrame:
    return boundaries.select(
        F.col("wd23cd").alias("ward_code"), F.col("wd23nm").alias("ward_name"),
        F.col("lad23nm").alias("local_authority"), F.col("wkt").alias("wkt_geometry"),
        F.lit(C.LAYER_HOSPITAL_WARD).alias("layer_type"))


def dim_wards(wards: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Ward attributes and tier beside the boundary text."""
    outlines = boundaries.select(F.col("wd23cd").alias("area_code"), F.col("wkt").alias("wkt_geometry"))
    return (wards.join(outlines, "area_code", "left")
            .select("area_code", "area_name", "caz_tier", "distance_to_caz_metres", "latitude",
                    "longitude", "wkt_geometry", F.lit(C.LAYER_WARD).alias("layer_type")))


def rounded_wkt(wkt: Column, digits: int = C.WKT_DIGITS) -> Column:
    """The same geometry with rounded coordinates."""
    return to_wkt(parse_wkt(wkt), kind_of(wkt), digits)


def simplified_wkt(wkt: Column, tolerance: float = C.SIMPLIFY_TOLERANCE, digits: int = C.WKT_DIGITS) -> Column:
    """Fewer vertices, rounded: short enough for a report's text cell."""
    return to_wkt(simplify(parse_wkt(wkt), tolerance), kind_of(wkt), digits)


def point_wkt(longitude: Column, latitude: Column) -> Column:
    """Point text at the coordinates' full precision."""
    def text(value: Column) -> Column:
        return number_text(value, 15)

    return F.concat(F.lit("POINT("), text(longitude), F.lit(" "), text(latitude), F.lit(")"))


def _tier_layer(tiers: DataFrame) -> DataFrame:
    return tiers.select(
        F.col("caz_tier").alias("map_id"),
        F.concat(F.lit(C.TIER_LABEL_PREFIX), F.col("caz_tier")).alias("map_label"),
        simplified_wkt(F.col("wkt")).alias("wkt_geometry"),
        F.lit(C.LAYER_ZONE).alias("layer_type"), "caz_tier")


def _stack(first: DataFrame, second: DataFrame) -> DataFrame:
    """Union in the second layer's column order; what the first lacks is NULL."""
    return first.unionByName(second, allowMissingColumns=True).select(*second.columns)


def map_layer_sites(tiers: DataFrame, sites: DataFrame) -> DataFrame:
    """Tier polygons and site points in one table."""
    points = sites.select(
        F.col("site_id").cast("string").alias("map_id"), F.col("site_name").alias("map_label"),
        point_wkt(F.col("longitude"), F.col("latitude")).alias("wkt_geometry"),
        F.lit(C.LAYER_SITE).alias("layer_type"), "caz_tier", "site_type", "latitude", "longitude",
        "data_source", "start_date", "end_date", "distance_to_caz_metres")
    return _stack(_tier_layer(tiers), points)


def map_layer_wards(tiers: DataFrame, dim_wards: DataFrame) -> DataFrame:
    """Tier polygons and simplified ward polygons in one table."""
    wards = dim_wards.select(
        F.col("area_code").cast("string").alias("map_id"), F.col("area_name").alias("map_label"),
        simplified_wkt(F.col("wkt_geometry")).alias("wkt_geometry"),
        F.lit(C.LAYER_WARD).alias("layer_type"), "caz_tier",
        F.col("area_code").cast("string").alias("area_code"), "area_name",
        "distance_to_caz_metres", "latitude", "longitude")
    return _stack(_tier_layer(tiers), wards)


def oversized_text(layer: DataFrame, limit: int = C.TEXT_CELL_LIMIT) -> DataFrame:
    """Geometries too long for one text cell of the reporting tool."""
    return layer.filter(F.length("wkt_geometry") >= limit).select("map_id", F.length("wkt_geometry").alias("length"))
