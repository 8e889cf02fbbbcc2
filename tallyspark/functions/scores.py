"""Scores and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371008.8


def direct_material(n_flags: Column) -> Column:
    return F.least(n_flags * 0.2, F.lit(1.0))


def values_alignment(topics: Column, tags: Column) -> Column:
    """Topics among the tags, repeated ones each time, per tag; may be above 1."""
    hits = F.size(F.filter(topics, lambda t: F.array_contains(tags, t)))
    return F.when(F.size(tags) > 0, hits / F.size(tags)).otherwise(0.0)


def actionability(age_days: Column) -> Column:
    return F.when(age_days <= 30, 1.0).when(age_days <= 60, 0.5).otherwise(0.0)


def composite(material: Column, values: Column, action: Column) -> Column:
    return material * 0.5 + values * 0.3 + action * 0.2


def election_proximity(days: Column) -> Column:
    """1 in the last 30 days, falling to 0.4 at 90 and to 0 at 365; 0 when past."""
    return F.when(days.isNull() | (days < 0) | (days > 365), 0.0).when(days <= 30, 1.0).when(days <= 90, 1.0 - (days - 30) / 60 * 0.6).otherwise(0.4 - (days - 90) / 275 * 0.4)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where it is undefined: beside a vector of length zero, of no finite length, or of another size."""
    lengths = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    found = F.when((lengths > 0) & (lengths < float("inf")), dot(a, b) / lengths)
    return F.when(~F.isnan(found), found)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    h = F.pow(F.sin((F.radians(lat2) - F.radians(lat1)) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), 2)
    return 2 * EARTH_M * F.asin(F.least(F.sqrt(h), F.lit(1.0)))


def time_zone(lon: Column) -> Column:
    # Western limits of the zones in degrees.
    steps = ((-82.5, "America/New_York"), (-97.5, "America/Chicago"), (-112.5, "America/Denver"), (-127.5, "America/Los_Angeles"), (-145.0, "America/Anchorage"))
    out = F.when(lon.isNull(), None)
    for limit, zone in steps:
        out = out.when(lon > limit, zone)
    return out.otherwise("Pacific/Honolulu")


def completeness(present: list[Column]) -> Column:
    """Share of conditions that hold, in per cent, rounded."""
    return F.round(sum((F.coalesce(c, F.lit(False)).cast("int") for c in present), F.lit(0)) * 100 / len(present)).cast("int")
