"""Keyed writes as rebuilds: upserts, amendments, replacement of a parent's children, pruning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def free(name: str, *tables: DataFrame) -> str:
    """The name, or a longer one, that no column of the tables has in any case: for what is added for a while and taken away again."""
    held = {c.lower() for t in tables for c in t.columns}
    while name.lower() in held:
        name += "_"
    return name


def left_join(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """rows with what a table says of their key, as a left join gives it. Rows without a key are not dealt by it, as they all would go to one task: they pass by. rows are read twice."""
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema.fields if f.name != key]
    return rows.where(F.col(key).isNotNull()).join(table, key, "left").unionByName(rows.where(F.col(key).isNull()).select("*", *rest))


#: Rows of the larger table, of which each has many pairs, that one partition of pairs_of() has, and the least number of partitions; pairs that one has about at most, as what they are joined to is held whole.
ROWS_OF_PAIRS, PARTS_OF_PAIRS, PAIRS = 2000, 96, 2 << 20


def parts_of_pairs(many: DataFrame, few: DataFrame, on: str) -> int:
    """The number of partitions of pairs_of()."""
    rows, most = many.count(), few.groupBy(on).count().agg(F.max("count")).first()[0] or 0
    return max(PARTS_OF_PAIRS, int(many.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_OF_PAIRS), -(-rows * most // PAIRS))


def pairs_of(many: DataFrame, few: DataFrame, on: str, deal: str, parts: int | None = None, told: DataFrame | None = None) -> DataFrame:
    """many.join(few, on), where few keys have many rows on both sides: rows of `many` are dealt by `deal` and not by the key, and `few` is sent to them.

    All pairs of a value of `deal` are in one partition, and what is joined to them by it and more columns is dealt by it alone, so that the pairs are not dealt again: that needs Spark not to
    ask for all columns of a join, which is set for the session. The partitions are not fewer than those of a shuffle, or Spark would deal the pairs again by the greater number.
    Their number follows the pairs, and not the rows of `many` alone, so that a partition's pairs do not grow with `few`.
    parts: that number, if it is known, as both tables are read to find it. told: what else there is of a value of `deal`, once each; it meets `many` where that has been dealt, before there are pairs.
    """
    many.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    dealt = many.repartition(parts or parts_of_pairs(many, few, on), deal)  # a number is kept, where Spark would put small partitions together before their pairs are made
    if told is not None:
        dealt = dealt.join(told.hint("shuffle_hash"), deal, "left")
    return dealt.join(F.broadcast(few), on)


def first_by(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order; the caller's order should leave no ties."""
    n = free("_n", rows)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(n) == 1).drop(n)


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """All stored rows with those of the batch put in their place or added; action is kept, updated or created. Keys of the batch are unique."""
    old = free("_old", batch)
    new = batch.join(stored.select(*keys).withColumn(old, F.lit(True)), keys, "left")
    new = new.withColumn("action", F.when(F.col(old), "updated").otherwise("created")).drop(old)
    return stored.join(batch.select(*keys), keys, "left_anti").withColumn("action", F.lit("kept")).unionByName(new)


def replay(rows: DataFrame, keys: list[str], version: str, seq: str) -> DataFrame:
    """What is left of each key when its rows arrive one after another: a row replaces the one held unless its version is older.

    Without a version a row is never older, nor is any row older than it, so this is a fold and not a maximum: versions
    2, none, 1 end at 1. After the last row without a version, the greatest version wins, of equals the later; a version
    below that of the row held is passed over. That needs no loop: rows before the last without a version cannot matter.
    """
    last = free("_reset", rows)
    reset = rows.where(F.col(version).isNull()).groupBy(*keys).agg(F.max(seq).alias(last))
    rows = rows.join(reset, keys, "left").where(F.col(last).isNull() | (F.col(seq) >= F.col(last))).drop(last)
    return first_by(rows, keys, F.desc_nulls_last(version), F.desc(seq))


def upsert_monotonic(stored: DataFrame, batch: DataFrame, keys: list[str], version: str, seq: str) -> DataFrame:
    """stored after the batch arrives, by the rule of replay(); stored rows came before."""
    both = stored.withColumn(seq, F.lit(-1).cast("long")).unionByName(batch.withColumn(seq, F.col(seq).cast("long")))
    return replay(both, keys, version, seq).drop(seq)


def replace_children(stored: DataFrame, batch: DataFrame, parent: str) -> DataFrame:
    """The children of every parent in the batch are those of the batch."""
    return stored.join(batch.select(parent).distinct(), parent, "left_anti").unionByName(batch)


def prune(stored: DataFrame, synced: DataFrame, key: str, scope: Column, capped: bool = False) -> DataFrame:
    """Rows in scope that were not synced go; nothing goes if nothing was synced or the run was capped."""
    if capped or synced.isEmpty():
        return stored
    gone = stored.where(scope).join(synced.select(key), key, "left_anti").select(key)
    return stored.join(gone, key, "left_anti")


def union_first_wins(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several tables; of a key those of the first table that has it, least by all columns."""
    place = free("_p", *frames)
    out = frames[0].withColumn(place, F.lit(0))
    for k, frame in enumerate(frames[1:], 1):
        out = out.unionByName(frame.withColumn(place, F.lit(k)))
    rest = [c for c in frames[0].columns if c not in keys]
    return first_by(out, keys, F.asc(place), *[F.asc(c) for c in rest]).drop(place)


def retain(rows: DataFrame, ts: str, as_of: Column, days: int) -> DataFrame:
    return rows.where(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))
