"""Point in polygon over an edge table, and simple region predicates."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_geojson(text: str) -> list[list[list[tuple[float, float]]]]:
    """Polygons as rings of (lon, lat); a polygon's first ring is its outline, the others are holes."""

    def polygons(g: dict) -> list:
        kind = g.get("type")
        if kind == "Feature":
            return polygons(g.get("geometry") or {})
        if kind == "FeatureCollection":
            found = [p for f in g.get("features", []) for p in polygons(f)]
            if not found:
                raise ValueError("the collection holds no polygon")
            return found
        if kind == "Polygon":
            return [g["coordinates"]]
        if kind == "MultiPolygon":
            return list(g["coordinates"])
        raise ValueError(f"{kind} isn't a boundary")

    return [[[(float(x[0]), float(x[1])) for x in ring] for ring in p] for p in polygons(json.loads(text))]


def boundary_edges(spark: SparkSession, polygons: list) -> DataFrame:
    """poly, ring, x1, y1, x2, y2: every side of every ring, as a constant of the plan."""
    rows = [(p, r, *ring[i - 1], *ring[i]) for p, rings in enumerate(polygons) for r, ring in enumerate(rings) for i in range(len(ring))]
    values = ", ".join("({}, {}, {!r}D, {!r}D, {!r}D, {!r}D)".format(*x) for x in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(poly, ring, x1, y1, x2, y2)")


def contains(polygons: list, lon: Column, lat: Column) -> Column:
    """Whether a point lies in any polygon and in none of its holes, for boundaries small enough to be an expression."""

    def inside(ring: list) -> Column:
        crossed = F.lit(0)
        for i, (x2, y2) in enumerate(ring):
            x1, y1 = ring[i - 1]
            if y1 != y2:
                cross = ((F.lit(y2) > lat) != (F.lit(y1) > lat)) & (lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2)
                crossed = crossed + cross.cast("int")
        return crossed % 2 == 1

    within = F.lit(False)
    for rings in polygons:
        one = inside(rings[0])
        for hole in rings[1:]:
            one = one & ~inside(hole)
        within = within | one
    return F.coalesce(within, F.lit(False))


def points_inside(points: DataFrame, edges: DataFrame, band_deg: float = 0.05) -> DataFrame:
    """The ids of points (id, lon, lat) inside the boundary, by parity of crossings, for boundaries of many sides. Points
    and edges meet in bands of latitude, an edge in each that it crosses, so that this is an equi-join."""
    band = lambda y: F.floor(y / band_deg)
    banded = edges.where("y1 <> y2").withColumn("band", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    crossing = F.expr("(y2 > lat) <> (y1 > lat) AND lon < (x1 - x2) * (lat - y2) / (y1 - y2) + x2")
    hits = points.withColumn("band", band(F.col("lat"))).join(banded, "band").where(crossing).groupBy("id", "poly", "ring").count().where("count % 2 = 1")
    polys = hits.groupBy("id", "poly").agg(F.max((F.col("ring") == 0).cast("int")).alias("out"), F.max((F.col("ring") > 0).cast("int")).alias("hole"))
    return polys.where("out = 1 AND hole = 0").select("id").distinct()


def accepts_region(regions: Column, deny_unscoped: Column, region: Column) -> Column:
    """Whether a node relays a message of a region; the empty region is an unscoped message."""
    named = F.exists(F.coalesce(regions, F.array()), lambda r: (r == "*") | (r == region))
    return F.when(F.coalesce(region, F.lit("")) == "", ~F.coalesce(deny_unscoped, F.lit(False))).otherwise(named)


def slug(scope: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(scope, "^#", "")), "[^a-z0-9-]", "-")
