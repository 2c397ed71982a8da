"""Distance tiers of sites and wards round a zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from airzone.functions.labels import tier
from airzone.functions.numeric import round_half_up
from airzone.functions.polygon import position_in, zone_edges
from airzone.functions.wkt import dimensions_of, kind_of, malformed
from airzone.operators.zones import zones_of

# Reference systems and type names of the spatial tables.
POINT_SRID, ZONE_SRID = 27700, 4326
TYPE_NAMES = {"POINT": "ST_Point", "POLYGON": "ST_Polygon", "MULTIPOLYGON": "ST_MultiPolygon"}


def _type_name(wkt: Column) -> Column:
    names = F.create_map(*[F.lit(text) for pair in TYPE_NAMES.items() for text in pair])
    return F.try_element_at(names, kind_of(wkt))


def with_tier(places: DataFrame, zone: DataFrame, *, straddle: bool = False) -> DataFrame:
    """Add ``caz_tier`` and ``distance_to_caz_metres`` to rows with longitude and latitude.

    The zone is one row; its edges enter as a single value, so each place is
    classified where it is, without a join. A zone table of several rows is an error.
    ``straddle`` gives places on the outline their own label.
    """
    found = places.withColumn("_edges", zone_edges(zone).select("edges").scalar()).withColumn(
        "_at", position_in("_edges"))
    distance, on_edge = F.col("_at.distance"), F.col("_at.on_edge")
    return found.withColumns({
        "caz_tier": tier(F.col("_at.inside"), distance, on_edge if straddle else None),
        "distance_to_caz_metres": round_half_up(distance, 2).cast("decimal(10,2)"),
    }).drop("_at", "_edges")


def site_tiers(sites: DataFrame, zone: DataFrame) -> DataFrame:
    return with_tier(sites, zone)


def ward_tiers(wards: DataFrame, zone: DataFrame) -> DataFrame:
    return with_tier(wards, zone, straddle=True)


def ward_of_site(sites: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Wards whose outline holds a site; wards overlap, and a site outside all of them has no row."""
    return zones_of(sites.select("site_id", "longitude", "latitude"), boundaries, "wd23cd").select("site_id", "wd23cd", "on_edge")


def wards_about(wards: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Outlines that hold a ward's point, its own among them."""
    return zones_of(wards.select("area_code", "longitude", "latitude"), boundaries, "wd23cd").select("area_code", "wd23cd", "on_edge")


def tier_distribution(entities: dict[str, DataFrame]) -> DataFrame:
    """Count and distance range of each entity type's tiers."""
    frames = [df.groupBy("caz_tier").agg(
        F.count(F.lit(1)).alias("total_count"),
        F.min("distance_to_caz_metres").alias("min_distance_m"),
        F.max("distance_to_caz_metres").alias("max_distance_m"),
    ).select(F.lit(name).alias("entity_type"), "*") for name, df in entities.items()]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def geometry_audit(zone: DataFrame, sites: DataFrame) -> DataFrame:
    """Reference system, dimensions and geometry type of each spatial row."""
    outlines = zone.select(
        F.lit("caz_polygon").alias("spatial_table"), F.col("name").alias("id"), "name",
        F.lit(ZONE_SRID).alias("srid"), dimensions_of(F.col("wkt")).alias("dimensions"),
        _type_name(F.col("wkt")).alias("geom_type"))
    located = F.col("longitude").isNotNull() & F.col("latitude").isNotNull()
    points = sites.select(
        F.lit("monitoring_sites").alias("spatial_table"), F.col("site_id").cast("string").alias("id"),
        F.col("site_name").alias("name"), F.when(located, POINT_SRID).alias("srid"),
        F.when(located, 2).alias("dimensions"), F.when(located, F.lit(TYPE_NAMES["POINT"])).alias("geom_type"))
    return outlines.unionByName(points)


def outline_audit(geometries: DataFrame, key: str, wkt: str, table: str, srid: int = ZONE_SRID) -> DataFrame:
    """Rows per geometry type and dimension of a table of outlines."""
    return (geometries.groupBy(F.lit(table).alias("spatial_table"), F.lit(srid).alias("srid"),
                               dimensions_of(F.col(wkt)).alias("dimensions"),
                               _type_name(F.col(wkt)).alias("geom_type"))
            .agg(F.count(key).alias("geometries")))


def malformed_outlines(geometries: DataFrame, key: str, wkt: str) -> DataFrame:
    """Rows whose outline cannot be read; the map layers and zones show them without a geometry."""
    return geometries.filter(malformed(F.col(wkt))).select(key, wkt)
