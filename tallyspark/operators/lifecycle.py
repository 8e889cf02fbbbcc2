"""Bills: lifecycle, stages, change detection; caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import free

# Signs of a dead bill in its stage and status.
DEAD_STAGES = ("failed-passage",)
DEAD_STATUS = "(?i)died|failed deadline|inactive file|withdrawn|failed passage"


def is_dead(status: Column, stage: Column, session: Column, last_action: Column, last_date: Column, today: Column, sessions: list[str]) -> Column:
    """Dead by stage, by status, by a veto not overridden, or by the end of its session unless it is chaptered or acted on this year."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    vetoed = yes(status.rlike("(?i)vetoed")) & ~yes(last_action.rlike("(?i)overrid"))
    expired = ~yes(session.isin(*sessions)) & ~yes(stage == "chaptered") & ~yes(F.year(last_date) == F.year(today))
    return yes(stage.isin(*DEAD_STAGES)) | yes(status.rlike(DEAD_STATUS)) | vetoed | expired


def is_active(status: Column, dead: Column) -> Column:
    return F.coalesce(status.rlike("(?i)^active bill"), F.lit(False)) & ~dead


def stage(status: Column, patterns: list[tuple[str, str]]) -> Column:
    """The stage of the first pattern that a status matches."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern, name in patterns:
        out = out.when(status.rlike(f"(?i){pattern}"), name)
    return out


def changed(found: DataFrame, stored: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows that are new or differ from what is stored in a column; nulls equal nulls."""
    own, known = {c: free(f"_{c}", found) for c in columns}, free("_known", found)
    old = stored.select(key, *[F.col(c).alias(own[c]) for c in columns], F.lit(True).alias(known))
    out = found.join(old, key, "left")
    same = F.col(known).isNotNull()
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(own[c]))
    return out.where(~same).select(*found.columns)


def reuse_by_hash(rows: DataFrame, done: DataFrame, content: str, result: str, seq: str) -> DataFrame:
    """A result that a row of the same content already has, the latest of them."""
    other = free("_r", rows)
    last = done.where(F.col(result).isNotNull() & F.col(content).isNotNull()).groupBy(content).agg(F.max_by(result, seq).alias(other))
    return rows.join(last, content, "left").withColumn(result, F.coalesce(result, other)).drop(other)


def valid(cache: DataFrame, as_of: Column, template_hash: str) -> DataFrame:
    return cache.where((F.col("expires_at") > as_of) & (F.col("template_hash") == template_hash))
