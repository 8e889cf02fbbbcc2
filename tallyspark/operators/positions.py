"""Committees' positions on measures, with the evidence for each, kept up to date as filings, spending and titles change.

Evidence is a row for every filing or payment that may name a measure, linked or not, with the keys it was looked up by. A
change touches the evidence of the changed rows, and of the rows that were looked up by a key which now leads elsewhere;
all other evidence stays. A position stands as long as it has evidence and is withdrawn with the last of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import side
from ..functions.text import normal_title

ROW = ("kind", "row_id")
POSITION = ("committee_id", "proposition_id", "position")
#: A filing that is about a measure; other kinds are payments, from which a position is inferred.
FILING = "filing"


def titles(propositions: DataFrame) -> DataFrame:
    """(key, proposition_id): the number and the title of each proposition (proposition_id, external_id, title, seq) as normal keys; of equal ones the last by seq, a title before a number."""
    rows = propositions.select("proposition_id", F.explode(F.array(F.struct(F.lit(0).alias("n"), F.col("external_id").alias("said")), F.struct(F.lit(1).alias("n"), F.col("title").alias("said")))).alias("x"), "seq")
    keyed = rows.select(normal_title(F.col("x.said")).alias("key"), F.struct("seq", "x.n", "proposition_id").alias("o")).where("key <> ''")
    return keyed.groupBy("key").agg(F.max("o")["proposition_id"].alias("proposition_id"))


def of_filings(filings: DataFrame, money: DataFrame) -> DataFrame:
    """Filings (filing_id, ballot_number, ballot_name, side) as rows for evidence(); their committee is the least that money (filing_id, committee_id) names for the filing."""
    owner = money.where(F.col("committee_id").isNotNull() & F.col("filing_id").isNotNull()).groupBy("filing_id").agg(F.min("committee_id").alias("committee_id"))
    rows = filings.join(owner, "filing_id", "left")
    return rows.select(F.lit(FILING).alias("kind"), F.col("filing_id").cast("string").alias("row_id"), "committee_id", F.array("ballot_number", "ballot_name").alias("said"), F.col("side"))


def of_payments(rows: DataFrame, kind: str, id_col: str) -> DataFrame:
    """Payments (id, committee_id, proposition_title, side) as rows for evidence()."""
    return rows.select(F.lit(kind).alias("kind"), F.col(id_col).cast("string").alias("row_id"), "committee_id", F.array("proposition_title").alias("said"), F.col("side"))


def _looked_up(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (kind, row_id, committee_id, keys, position) with the proposition of the first key that is one."""
    each = rows.select(*ROW, F.posexplode("keys").alias("at", "key"))
    found = each.join(known, "key").groupBy(*ROW).agg(F.min_by("proposition_id", "at").alias("proposition_id"))
    return rows.join(found, list(ROW), "left").select(*ROW, "committee_id", "keys", "position", "proposition_id")


def evidence(rows: DataFrame, known: DataFrame) -> DataFrame:
    """kind, row_id, committee_id, keys, position, proposition_id of rows (kind, row_id, committee_id, said, side); null where it is not clear. kind and row_id are unique."""
    keys = F.filter(F.transform("said", normal_title), lambda k: F.coalesce(k, F.lit("")) != "")
    return _looked_up(rows.select(*ROW, "committee_id", keys.alias("keys"), side(F.col("side")).alias("position")), known)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key): keys that lead to another proposition than before, or did not or no longer lead to one."""
    old = before.select("key", F.col("proposition_id").alias("was"))
    return old.join(after, "key", "full").where(~F.col("was").eqNullSafe(F.col("proposition_id"))).select("key")


def updated(stored: DataFrame, changed: DataFrame, gone: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """The evidence after a change, equal to that of a full run.

    changed: rows as evidence() takes them, new or altered. gone: (kind, row_id) that are no more. before, after: titles() of then and now.
    """
    untouched = stored.join(changed.select(*ROW).unionByName(gone.select(*ROW)), list(ROW), "left_anti")
    keys = moved(before, after)
    again = untouched.select(*ROW, F.explode("keys").alias("key")).join(keys, "key", "left_semi").select(*ROW).distinct()
    asked = untouched.join(again, list(ROW), "left_semi").drop("proposition_id")
    kept = untouched.join(again, list(ROW), "left_anti")
    return kept.unionByName(_looked_up(asked, after)).unionByName(evidence(changed, after))


def positions(found: DataFrame) -> DataFrame:
    """(committee_id, proposition_id, position, is_primary, source_filing, n_evidence): is_primary if a filing says so, by the last filing that does."""
    linked = found.where(F.col("committee_id").isNotNull() & F.col("proposition_id").isNotNull() & F.col("position").isNotNull())
    filing = F.when(F.col("kind") == FILING, F.col("row_id"))
    return linked.groupBy(*POSITION).agg((F.count(filing) > 0).alias("is_primary"), F.max(filing).alias("source_filing"), F.count(F.lit(1)).alias("n_evidence"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Positions of both, as they are now (as they were if withdrawn), with action: kept, created, updated or withdrawn."""
    rest = ("is_primary", "source_filing", "n_evidence")
    old = before.select(*(F.col(c).alias(f"old_{c}") for c in (*POSITION, *rest)))
    both = after.join(old, [after[c] == old[f"old_{c}"] for c in POSITION], "full")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(c).eqNullSafe(F.col(f"old_{c}"))
    action = F.when(F.col("committee_id").isNull(), "withdrawn").when(F.col("old_committee_id").isNull(), "created").when(same, "kept").otherwise("updated")
    return both.select(*(F.coalesce(F.col(c), F.col(f"old_{c}")).alias(c) for c in (*POSITION, *rest)), action.alias("action"))
