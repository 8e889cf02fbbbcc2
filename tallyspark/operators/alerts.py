"""Alert rules over event windows, from one definition for batches and streams.

Values are kept as counts by bucket: bucket b holds the values above g**(b-1) and up to g**b. Counts add up, so summaries of parts,
windows or streams merge without loss, and a quantile read from them is off by at most the relative error asked for (values
below LEAST by that much).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of quantiles; values up to this one share the lowest bucket.
ERROR, LEAST = 0.01, 1e-6


def _base(error: float) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket of a value; null for none and for values that are no number."""
    v = value.cast("double")
    low = math.ceil(round(math.log(LEAST) / math.log(_base(error)), 9))
    at = F.ceil(F.round(F.log(F.greatest(v, F.lit(LEAST))) / math.log(_base(error)), 9)).cast("int")
    return F.when(v.isNotNull() & ~F.isnan(v), F.greatest(at, F.lit(low)))


def bucket_value(at: Column, error: float = ERROR) -> Column:
    """The value a bucket stands for: no value in it is further off than the error."""
    return F.pow(F.lit(_base(error)), at) * F.lit(2 / (1 + _base(error)))


def quantile(histogram: Column, q: float, error: float = ERROR) -> Column:
    """The q-quantile (the value of rank ceil(q * n), at least the first) of a histogram, an array of struct<bucket, n> in order; null where it is empty."""
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    rank = F.greatest(F.ceil(F.round(total * F.lit(q), 9)), F.lit(1).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("at"))
    step = lambda s, x: F.struct((s["seen"] + x["n"]).alias("seen"), F.when(s["at"].isNull() & (s["seen"] + x["n"] >= rank), x["bucket"]).otherwise(s["at"]).alias("at"))
    return bucket_value(F.aggregate(histogram, start, step, lambda s: s["at"]), error)


def merged(a: Column, b: Column) -> Column:
    """Two histograms as one."""
    both = F.concat(a, b)
    buckets = F.array_sort(F.array_distinct(F.transform(both, lambda x: x["bucket"])))
    return F.transform(buckets, lambda k: F.struct(k.alias("bucket"), F.aggregate(F.filter(both, lambda x: x["bucket"] == k), F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n")))


@dataclass(frozen=True)
class Rule:
    """Fires for a group in a window whose measure is above the limit, once that has held for `hold` (an interval such as 5 minutes).

    measure: "failures" for the share of failed events, or a number for that quantile of their values, of events of the kinds given (None: all).
    """

    name: str
    measure: str | float
    limit: float
    kinds: tuple[str, ...] | None = None
    window: str = "5 minutes"
    slide: str = "1 minute"
    hold: str = "5 minutes"


# The rules a deployment runs by, on kinds of events http, ocr, scan and analysis; latency in seconds.
RULES = (
    Rule("http_errors", "failures", 0.05, ("http",)), Rule("ocr_failures", "failures", 0.10, ("ocr",), "10 minutes"), Rule("scan_failures", "failures", 0.05, ("scan",), "10 minutes"),
    Rule("scan_latency", 0.95, 5.0, ("scan",)), Rule("analysis_failures", "failures", 0.10, ("analysis",), "10 minutes"),
)


def summaries(events: DataFrame, ts: str, group: str, kind: str, failed: Column, value: str, window: str, slide: str, late: str | None = None, error: float = ERROR) -> DataFrame:
    """(start, end, group, kind, n, failures, histogram) of each window in which a group had events of a kind.

    Events are first counted by bucket, in the tasks and then over the shuffle, so that a common group is a few hundred
    rows before its windows are put together. late: for streams, how late events may come.
    """
    rows = events.where(F.col(ts).isNotNull() & F.col(group).isNotNull())
    rows = rows.withWatermark(ts, late) if late else rows
    counted = rows.groupBy(F.window(ts, window, slide).alias("w"), F.col(group).alias("group"), F.col(kind).alias("kind"), bucket(F.col(value), error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(failed).alias("failures"))
    kept = F.sort_array(F.collect_list(F.when(F.col("bucket").isNotNull(), F.struct("bucket", "n"))))
    out = counted.groupBy("w", "group", "kind").agg(F.sum("n").alias("n"), F.sum("failures").alias("failures"), kept.alias("histogram"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "group", "kind", "n", "failures", "histogram")


def measured(events: DataFrame, rule: Rule, ts: str, group: str, kind: str, failed: Column, value: str, late: str | None = None) -> DataFrame:
    """(rule, group, start, end, n, measure, above) for each window of the rule that holds events of it; the same for a table and for a stream, there in append mode."""
    rows = events.where(F.col(kind).isin(*rule.kinds)) if rule.kinds else events
    parts = summaries(rows.withColumn("_all", F.lit("all")), ts, group, "_all", failed, value, rule.window, rule.slide, late)
    found = F.col("failures") / F.col("n") if rule.measure == "failures" else quantile(F.col("histogram"), float(rule.measure))
    return parts.select(F.lit(rule.name).alias("rule"), "group", "start", "end", "n", found.alias("measure")).withColumn("above", F.coalesce(F.col("measure") > rule.limit, F.lit(False)))


def fired(windows: DataFrame, slide: str, hold: str) -> DataFrame:
    """(rule, group, since, fired_at, until, windows, worst): each stretch of windows above the limit, without a gap, that lasted for `hold`.

    since: end of the first such window; fired_at: when it had held for long enough; until: end of the last one. windows: as measured() gives them, of rules of one slide.
    """
    above = windows.where("above")
    order = Window.partitionBy("rule", "group").orderBy("end")
    gap = F.lag("end").over(order).isNull() | (F.lag("end").over(order) + F.expr(f"INTERVAL {slide}") < F.col("end"))
    stretch = above.withColumn("_new", gap.cast("int")).withColumn("_stretch", F.sum("_new").over(order))
    out = stretch.groupBy("rule", "group", "_stretch").agg(F.min("end").alias("since"), F.max("end").alias("until"), F.count(F.lit(1)).alias("windows"), F.max("measure").alias("worst"))
    held = F.col("since") + F.expr(f"INTERVAL {hold}")
    return out.where(F.col("until") >= held).select("rule", "group", "since", held.alias("fired_at"), "until", "windows", "worst")


def all_fired(events: DataFrame, ts: str, group: str, kind: str, failed: Column, value: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What fired() says of each rule, in one table."""
    out = None
    for rule in rules:
        one = fired(measured(events, rule, ts, group, kind, failed, value), rule.slide, rule.hold)
        out = one if out is None else out.unionByName(one)
    return out
