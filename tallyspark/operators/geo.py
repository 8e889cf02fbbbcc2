"""Points, boxes, radii and polygons."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import haversine


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Strictly inside; the edge is out."""
    return (lon > west) & (lon < east) & (lat > south) & (lat < north)


def within(lon: Column, lat: Column, at_lon: float, at_lat: float, metres: float) -> Column:
    """Within a distance; a box of latitudes comes first and can be pushed to the scan."""
    span = metres / 111_000.0
    return lat.between(at_lat - span, at_lat + span) & (haversine(lon, lat, F.lit(at_lon), F.lit(at_lat)) <= metres)


def in_rings(lon: Column, lat: Column, rings: Column) -> Column:
    """Inside by the even-odd rule over all rings (array of arrays of struct x, y, closed)."""

    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cross = lambda e: ((e["a"]["y"] > lat) != (e["b"]["y"] > lat)) & (lon < (e["b"]["x"] - e["a"]["x"]) * (lat - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
        return F.size(F.filter(edges, cross))

    return F.aggregate(rings, F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def locate(points: DataFrame, areas: DataFrame, point_id: str, area_id: str, cell: float = 1.0) -> DataFrame:
    """(point, area) for each point inside an area: both are put into grid cells, joined by cell, and tested exactly."""
    bound = lambda side, pick: F.expr(f"array_{pick}(transform(flatten(rings), p -> p.{side}))")
    span = lambda side: F.sequence(F.floor(bound(side, "min") / cell), F.floor(bound(side, "max") / cell))
    cells = areas.withColumn("_cx", F.explode(span("x"))).withColumn("_cy", F.explode(span("y"))).select(area_id, "rings", "_cx", "_cy")
    rows = points.withColumn("_cx", F.floor(F.col("lon") / cell)).withColumn("_cy", F.floor(F.col("lat") / cell))
    return rows.join(cells, ["_cx", "_cy"]).where(in_rings(F.col("lon"), F.col("lat"), F.col("rings"))).select(point_id, area_id)


def nearby_same_content(rows: DataFrame, content: str, lon: str, lat: str, at: dict, metres: float) -> DataFrame:
    """Rows of the same content within a distance, nearest first."""
    own = rows.where(F.col(content) == at[content]).withColumn("metres", haversine(F.col(lon), F.col(lat), F.lit(at[lon]), F.lit(at[lat])))
    return own.where(F.col("metres") <= metres).orderBy("metres")


def grid(c: Column, digits: int = 2) -> Column:
    return F.round(c.cast("decimal(11,8)"), digits)


def with_noise(lat: Column, lon: Column, key: Column, seed: int = 0, most: float = 0.001) -> Column:
    """struct<lat, lon> moved by up to `most` degrees in a direction that key and seed give, so that a task that runs again moves a place alike; cut to valid degrees."""
    part = lambda n: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(n), key), 11) / float(1 << 53)
    turn, far = part(1) * (2 * math.pi), part(2) * most
    cut = lambda c, edge: F.greatest(F.least(c, F.lit(float(edge))), F.lit(float(-edge)))
    return F.struct(cut(lat + far * F.cos(turn), 90).alias("lat"), cut(lon + far * F.sin(turn), 180).alias("lon"))
