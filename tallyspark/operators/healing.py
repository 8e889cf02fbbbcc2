"""Whether a run of a source's extraction needs its rules made anew, from the history of its runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checks import COUNT_ERROR, COUNT_WARN, MISSING_ERROR, MISSING_WARN

#: Share of items a schema may reject; warnings for an item beyond which a run warns; times that rules are made anew before a source is left to people.
MOST_REJECTED, MOST_WARNINGS, MOST_HEALS = 0.5, 2, 2


def _listed(*found: Column) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _issues(r: Column, before: Column) -> tuple[Column, Column]:
    """Errors and warnings of a run whose source's last good one had so many items (null: none)."""
    share = F.when(r["items"] > 0, r["worst_missing"] / r["items"])
    rejected = F.when(r["items"] > 0, r["rejected"] / r["items"])
    drift = F.when((before > 0) & (r["items"] > 0), r["items"] / before)
    errors = _listed(
        F.when(~F.coalesce(r["ok"], F.lit(False)), "failed"), F.when(F.coalesce(r["items"], F.lit(0)) == 0, "no_items"), F.when(share > MISSING_ERROR, "missing_fields"), F.when(drift < COUNT_ERROR, "fewer_items"), F.when(rejected > MOST_REJECTED, "rejected_items")
    )
    warnings = _listed(F.when((share > MISSING_WARN) & (share <= MISSING_ERROR), "missing_fields"), F.when((drift >= COUNT_ERROR) & (drift < COUNT_WARN), "fewer_items"), F.when(r["warnings"] > MOST_WARNINGS * r["items"], "many_warnings"))
    return errors, warnings


def decisions(runs: DataFrame, source: list[str], most_heals: int = MOST_HEALS) -> DataFrame:
    """A row for each run: source, run, decision, previous, structure_changed, errors, warnings.

    runs: source, run, at, ok, items, worst_missing (items without the required field that is missing most), rejected (by the schema), warnings,
    structure. A run is good if it has no error; previous is the number of items of the source's last good one, structure_changed whether
    its pages looked otherwise. decision: ok, heal, or give_up once rules have been made anew most_heals times without a good run since; a good
    run, or pages that look otherwise than at the last attempt, start the count anew.

    What a run is compared with depends on how the ones before it ended, so a source's runs are read in order, as one
    array: they are a row for each time a source is read, and stay few beside its items. Runs of equal time go by their name.
    """
    fields = ["at", "run", "ok", "items", "worst_missing", "rejected", "warnings", "structure"]
    ordered = runs.withColumn("run", F.col("run").cast("string")).groupBy(*source).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_runs"))
    start = F.struct(F.lit(None).cast("bigint").alias("items"), F.lit(None).cast("string").alias("structure"), F.lit(0).alias("heals"), F.lit(None).cast("string").alias("tried"), F.array().cast("array<struct<run: string, decision: string, previous: bigint, structure_changed: boolean, errors: array<string>, warnings: array<string>>>").alias("decided"))

    def step(s: Column, r: Column) -> Column:
        errors, warnings = _issues(r, s["items"])
        good = F.size(errors) == 0
        heals = F.when(r["structure"].eqNullSafe(s["tried"]), s["heals"]).otherwise(F.lit(0))
        decision = F.when(good, "ok").when(heals < most_heals, "heal").otherwise("give_up")
        changed = F.when(s["structure"].isNotNull(), ~r["structure"].eqNullSafe(s["structure"]))
        row = F.struct(r["run"].alias("run"), decision.alias("decision"), s["items"].alias("previous"), changed.alias("structure_changed"), errors.alias("errors"), warnings.alias("warnings"))
        return F.struct(
            F.when(good, r["items"]).otherwise(s["items"]).alias("items"), F.when(good, r["structure"]).otherwise(s["structure"]).alias("structure"),
            F.when(good, 0).when(decision == "heal", heals + 1).otherwise(heals).alias("heals"), F.when(good, F.lit(None)).otherwise(r["structure"]).alias("tried"), F.concat(s["decided"], F.array(row)).alias("decided"),
        )

    out = ordered.select(*source, F.explode(F.aggregate("_runs", start, step, lambda s: s["decided"])).alias("_d"))
    return out.select(*source, "_d.*")


def run_of(items: DataFrame, source: list[str], required: list[str], rejected: Column, warnings: Column) -> DataFrame:
    """What decisions() needs of a run, counted over its items: items, worst_missing, rejected, warnings. A null or blank value is missing."""
    blank = lambda c: F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""))
    worst = F.greatest(*map(blank, required)) if len(required) > 1 else blank(required[0]) if required else F.lit(0).cast("long")
    return items.groupBy(*source).agg(F.count(F.lit(1)).alias("items"), worst.alias("worst_missing"), F.count_if(rejected).alias("rejected"), F.coalesce(F.sum(warnings), F.lit(0)).cast("long").alias("warnings"))
