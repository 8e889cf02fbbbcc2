"""Petitions on the map and in the feed of the last day, so that no single person's scan shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geo import grid, in_box

#: Scans a petition needs to be shown, hours of the feed, and days that count as recent.
LEAST_SCANS, HOURS, DAYS = 3, 24, 7


def alive(rows: DataFrame) -> DataFrame:
    """Petitions that are not deleted."""
    return rows.where((F.col("type") == "petition") & F.col("deleted_at").isNull())


def feed(rows: DataFrame, as_of: Column, least: int = LEAST_SCANS, hours: int = HOURS) -> DataFrame:
    """(content_hash, summary, scans, locations, latest, earliest) of petitions scanned in the last hours, by those of LEAST_SCANS scans or more.

    rows: type, content_hash, summary, lon, lat, created_at, deleted_at. Places are told apart by a grid of two decimals; scans without a place have none, and scans without a hash are of no petition.
    """
    recent = alive(rows).where((F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & F.col("content_hash").isNotNull())
    place = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), F.struct(grid(F.col("lat")), grid(F.col("lon"))))
    out = recent.groupBy("content_hash").agg(F.max("summary").alias("summary"), F.count(F.lit(1)).alias("scans"), F.countDistinct(place).alias("locations"), F.max("created_at").alias("latest"), F.min("created_at").alias("earliest"))
    return out.where(F.col("scans") >= least).withColumn("summary", F.coalesce("summary", F.lit("Petition scan recorded")))


def day(rows: DataFrame, as_of: Column, least: int = LEAST_SCANS, hours: int = HOURS) -> DataFrame:
    """One row: the feed as an array (latest first), scans by hour as an array (in order), all scans, and petitions."""
    recent = alive(rows).where(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours)))
    item = F.struct((-F.unix_micros(F.col("latest").cast("timestamp"))).alias("order"), "content_hash", "summary", "scans", "locations", "latest", "earliest")
    items = feed(rows, as_of, least, hours).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x.dropFields("order")).alias("items"))
    hourly = recent.groupBy(F.date_trunc("hour", "created_at").alias("hour")).agg(F.count(F.lit(1)).alias("scans"))
    hourly = hourly.agg(F.sort_array(F.collect_list(F.struct("hour", "scans"))).alias("hours"))  # a row for each hour of the feed
    stats = recent.agg(F.count(F.lit(1)).alias("total_scans"), F.countDistinct("content_hash").alias("active_petitions"))
    return items.join(hourly, F.lit(True)).join(stats, F.lit(True))


def markers(rows: DataFrame, box: tuple[float, float, float, float] | None = None, kind: str | None = None, since: Column | None = None, until: Column | None = None, most: int | None = None) -> DataFrame:
    """(id, lat, lon, type, created_at, total): scans that have a place, maybe within a box (west, south, east, north), of one type or time, the newest first; total: how many there are, also beyond `most`."""
    found = rows.where(F.col("lon").isNotNull() & F.col("lat").isNotNull())
    found = found.where(in_box(F.col("lon"), F.col("lat"), *box)) if box else found
    found = found.where(F.col("type") == kind) if kind else found
    found = found.where(F.col("created_at") >= since) if since is not None else found
    found = found.where(F.col("created_at") <= until) if until is not None else found
    found = found.select("id", "lat", "lon", "type", "created_at")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    shown = found.orderBy(F.desc_nulls_first("created_at"), F.asc("id")).limit(most) if most else found
    return shown.join(F.broadcast(total), F.lit(True))  # one row


def stats(rows: DataFrame, as_of: Column, days: int = DAYS) -> DataFrame:
    """One row: petitions, those with a place, and those of the last days."""
    return alive(rows).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("with_location"), F.count_if(F.col("created_at") >= as_of - F.make_dt_interval(F.lit(days))).alias("recent"))
