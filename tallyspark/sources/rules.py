"""Extraction rules as rows: an append-only table with versions, the choice of one for each source, and whether it may be used again.

A source is known by the key columns. A row of the store holds: the key, version, structure (hash of the pages the rules were
made for), prompt (hash of what they were made with), rules (JSON, see `html.items_of`), saved_at. Rows are never changed; what
holds at a time is what was saved last by then, so any earlier state can be asked for again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .html import extract_by_rule

KEY = ("region", "url", "kind")
HELD = ("version", "structure", "prompt", "rules", "saved_at")


def numbered(store: DataFrame | None, new: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """New rows (key, structure, prompt, rules, saved_at) with the next versions of their sources, ready to be appended.

    Versions go on from the highest that any row of the source has; several new rows of a source are numbered by time,
    then by their hashes and rules, so that a repeated run numbers them alike. Rows that are in the store already (all but the version) are left out.
    """
    own = [*key, "structure", "prompt", "rules", "saved_at"]
    new = new.select(*own).distinct()
    base = None
    if store is not None:
        same = [new[c].eqNullSafe(store[c]) for c in own]
        condition = same[0]
        for s in same[1:]:
            condition = condition & s
        new = new.join(store, condition, "left_anti")
        base = store.groupBy(*key).agg(F.max("version").alias("_last"))
    place = F.row_number().over(Window.partitionBy(*key).orderBy("saved_at", "structure", "prompt", "rules"))
    out = new.withColumn("version", place)
    if base is not None:
        condition = None
        for c in key:
            one = out[c].eqNullSafe(base[c])
            condition = one if condition is None else condition & one
        out = out.join(base, condition, "left").select(*(out[c] for c in own), (out["version"] + F.coalesce(base["_last"], F.lit(0))).alias("version"))
    return out.select(*key, F.col("version").cast("int").alias("version"), "structure", "prompt", "rules", "saved_at")


def current(store: DataFrame, as_of: Column | None = None, key: Sequence[str] = KEY) -> DataFrame:
    """The highest version of each source that was saved by a time; of one version saved twice, the later row. Aggregated before the shuffle."""
    rows = store.where(F.col("saved_at") <= as_of) if as_of is not None else store
    last = rows.groupBy(*key).agg(F.max(F.struct("version", "saved_at", "structure", "prompt", "rules")).alias("_h"))
    return last.select(*key, *(F.col(f"_h.{c}").alias(c) for c in HELD))


def decided(seen: DataFrame, chosen: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """For each seen row (key, structure, prompt, more columns): version of the chosen rules, reuse, and why not: no_rules, structure_changed, prompt_changed, both_changed.

    A null hash differs from all others. chosen: as current() gives it, a row for each source.
    """
    known = chosen.select(*(F.col(c).alias(f"_{c}") for c in key), F.col("version"), F.col("structure").alias("_structure"), F.col("prompt").alias("_prompt"), F.col("rules"))
    condition = None
    for c in key:
        one = F.col(c).eqNullSafe(F.col(f"_{c}"))
        condition = one if condition is None else condition & one
    structure = ~F.coalesce(F.col("structure") == F.col("_structure"), F.lit(False))
    prompt = ~F.coalesce(F.col("prompt") == F.col("_prompt"), F.lit(False))
    reason = F.when(F.col("version").isNull(), "no_rules").when(structure & prompt, "both_changed").when(structure, "structure_changed").when(prompt, "prompt_changed")
    return seen.join(known, condition, "left").withColumn("reason", reason).withColumn("reuse", F.col("reason").isNull()).drop(*(f"_{c}" for c in key), "_structure", "_prompt")


def extracted(pages: DataFrame, chosen: DataFrame, static: DataFrame | None = None, key: Sequence[str] = KEY, html: str = "html", row: Sequence[str] = ()) -> DataFrame:
    """Items of pages (key, html) by the rules of their source: key, row columns, version, place, fields, children.

    static: rules given by hand (key, rules), a row for each source; they go first, as version 0. Pages of sources without rules have no items.
    """
    rules = chosen.select(*key, "version", "rules")
    if static is not None:
        rules = static.select(*key, F.lit(0).alias("version"), "rules").unionByName(rules)
        rules = rules.groupBy(*key).agg(F.min(F.struct("version", "rules")).alias("_h")).select(*key, "_h.version", "_h.rules")
    found = pages.select(*key, *row, html).join(rules, list(key))
    return extract_by_rule(found, [*key, *row, "version"], html)


def outcomes(runs: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """How each version has done, of a log (key, version, ok, items, at): successes, failures, items of the last success that says them, and when it was last used."""
    ok = F.coalesce("ok", F.lit(False))
    return runs.groupBy(*key, "version").agg(
        F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"),
        F.max_by("items", F.when(ok & F.col("items").isNotNull(), F.col("at"))).alias("last_items"), F.max(F.when(ok, F.col("at"))).alias("last_used"),
    )
