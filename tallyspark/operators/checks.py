"""Quality of extracted tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Shares above or below which a run is in error or warns.
MISSING_ERROR, MISSING_WARN, COUNT_ERROR, COUNT_WARN = 0.5, 0.1, 0.5, 0.8


def missing_ratios(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(field, ratio) of rows without a value, in one pass."""
    empty = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    one = rows.agg(*[F.avg(F.when(empty(c), 1.0).otherwise(0.0)).alias(c) for c in fields])
    return one.unpivot([], fields, "field", "ratio")


def verdict(rows: DataFrame, required: list[str], previous: int | None) -> DataFrame:
    """One row: items, worst ratio of a required field, and error, warn or ok by the limits above."""
    ratios = missing_ratios(rows, required).agg(F.max("ratio").alias("worst"))
    out = rows.agg(F.count(F.lit(1)).alias("items")).join(ratios, F.lit(True))
    before = F.lit(previous)
    error = (F.col("items") == 0) | (F.col("worst") > MISSING_ERROR) | F.coalesce(F.col("items") < before * COUNT_ERROR, F.lit(False))
    warn = (F.col("worst") > MISSING_WARN) | F.coalesce(F.col("items") < before * COUNT_WARN, F.lit(False))
    return out.withColumn("verdict", F.when(error, "error").when(warn, "warn").otherwise("ok"))


def rates(rows: DataFrame, by: str, failed, value: str) -> DataFrame:
    """Failures' share, median and 95th percentile by group."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(failed, 1.0).otherwise(0.0)).alias("failure_rate"), F.percentile(value, 0.5).alias("p50"), F.percentile(value, 0.95).alias("p95"))
