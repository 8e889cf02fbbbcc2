"""Streams: resumable ingestion into a keyed table, hourly windows, and lockouts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.merge import replay
from ..sources import archive
from ..sources.commits import CommitLog, Conflict, children, remove


def ingest(spark: SparkSession, batches: DataFrame, target: str, ledger: str, checkpoint: str, position: tuple[list[str], str] | None = None):
    """Write a stream's batches beside each other below target; those in the ledger count, and current() folds them.

    A batch counts from the moment its entry stands in the ledger, which appears whole or not at all, and a batch that is in
    the ledger is not written again: a restart at any point neither loses nor doubles one. What a batch costs does not grow with the
    table. position: the columns of a source and of an item's id; then positions() knows how far each source has been read.
    """
    log = CommitLog(spark, ledger)

    def apply(batch: DataFrame, number: int) -> None:
        held = log.entries()
        if number in _done(held):
            return
        name = f"{number}-{uuid.uuid4().hex}"
        batch.withColumn("batch_number", F.lit(number).cast("long")).write.parquet(f"{target}/{name}")
        if position:
            watermark(batch, *position).write.parquet(f"{target}/positions/{name}")
        try:
            log.append({"batch": number, "folder": name, "positions": bool(position)}, len(held))
        except Conflict:
            if number not in _done(log.entries()):
                raise

    return batches.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _done(held: list[dict]) -> set[int]:
    return {n for e in held for n in (e.get("folds") or [e["batch"]])}


def _counting(held: list[dict]) -> list[dict]:
    """The last fold, if there is one, and the batches it does not hold."""
    last = next((e for e in reversed(held) if e.get("folds")), None)
    inside = set(last["folds"]) if last else set()
    return ([last] if last else []) + [e for e in held if not e.get("folds") and e["batch"] not in inside]


def current(spark: SparkSession, target: str, ledger: str, keys: list[str], version: str, seq: str) -> DataFrame:
    """The table after all batches in the ledger: each key's row by the rule of replay(), batches in their order, rows of one by seq."""
    rows = spark.read.parquet(*[f"{target}/{e['folder']}" for e in _counting(CommitLog(spark, ledger).entries())])
    return replay(rows.withColumn("arrival", F.struct("batch_number", seq)), keys, version, "arrival").drop("arrival", "batch_number", seq)


def compact(spark: SparkSession, target: str, ledger: str, keys: list[str], version: str, seq: str, keep: bool = False) -> None:
    """Fold what is there into one folder that stands for its batches from the moment the ledger says so; a stream may go on meanwhile.

    The folded rows came before those of later batches. Folders that nothing counts any more are deleted unless they are to be kept for readers who began before.
    """
    log = CommitLog(spark, ledger)
    held = log.entries()
    counting = _counting(held)
    if not counting:
        return
    last, name = max(_done(held)), f"folded-{uuid.uuid4().hex}"
    folded = current(spark, target, ledger, keys, version, seq).withColumn(seq, F.lit(0).cast("long")).withColumn("batch_number", F.lit(last).cast("long"))
    folded.write.parquet(f"{target}/{name}")
    log.append({"batch": last, "folder": name, "folds": sorted(_done(counting))}, len(held))
    if not keep:
        remove(spark, *(f"{target}/{e['folder']}" for e in counting))


def ingest_archive(spark: SparkSession, path: str, wanted: str, target: str, ledger: str, rows_of: Callable[[DataFrame], DataFrame], lines: int = 5_000_000, rounds: int | None = None) -> int:
    """Take in the members of archives by batches of lines, from where the ledger says that the last run ended; how many batches were added.

    Each round reads the next `lines` of every member (path, member, line, value), makes rows of them by rows_of and writes
    them; the round's entry holds the place reached in each member, so a run that ends anywhere goes on there. A member has to be
    unpacked from its beginning in each round, so a batch should be large. rounds: so many at most.
    """
    log, done = CommitLog(spark, ledger), 0
    while rounds is None or done < rounds:
        held = log.entries()
        after = {k: n for e in held for k, n in e.get("after", {}).items()}
        batch = archive.read(spark, path, wanted, after=after, lines=lines)
        name, number = f"{len(held)}-{uuid.uuid4().hex}", 1 + max((e["batch"] for e in held), default=-1)
        batch.write.parquet(f"{target}/lines/{name}")
        batch = spark.read.schema(batch.schema).parquet(f"{target}/lines/{name}")
        places = {f"{r['path']}!{r['member']}": r["next"] for r in batch.groupBy("path", "member").agg((F.max("line") + 1).alias("next")).collect()}  # a row for each member
        if places:
            rows_of(batch).withColumn("batch_number", F.lit(number).cast("long")).write.parquet(f"{target}/{name}")
            log.append({"batch": number, "folder": name, "after": places}, len(held))
            done += 1
        remove(spark, f"{target}/lines/{name}")
        if not places:
            return done
    return done


def vacuum(spark: SparkSession, target: str, ledger: str) -> list[str]:
    """Delete what attempts that never counted have left, where no stream is running; their names."""
    held = CommitLog(spark, ledger).entries()
    known, placed = {e["folder"] for e in _counting(held)} | {"positions", "lines"}, {e["folder"] for e in held if e.get("positions")}
    gone = [n for n in children(spark, target) if n not in known] + [f"positions/{n}" for n in children(spark, f"{target}/positions") if n not in placed]
    remove(spark, *(f"{target}/{n}" for n in gone))
    return gone


def positions(spark: SparkSession, target: str, ledger: str, source: list[str]) -> DataFrame | None:
    """For each source the highest id of all batches that count, and how many items were taken in; null before the first. The position only moves on, whatever order batches come in."""
    names = [e["folder"] for e in CommitLog(spark, ledger).entries() if e.get("positions")]
    if not names:
        return None
    rows = spark.read.parquet(*[f"{target}/positions/{n}" for n in names])
    return rows.groupBy(*source).agg(F.max("last_external_id").alias("last_external_id"), F.sum("items_ingested").alias("items_ingested"))


def beyond(rows: DataFrame, known: DataFrame | None, source: list[str], id_col: str) -> DataFrame:
    """Rows behind their source's position; all of a source that has none."""
    if known is None:
        return rows
    place = known.select(*source, "last_external_id")
    return rows.join(place, source, "left").where(F.col("last_external_id").isNull() | (F.col(id_col) > F.col("last_external_id"))).drop("last_external_id")


def watermark(rows: DataFrame, source: list[str], id_col: str) -> DataFrame:
    """For each source the last id taken in and how many were: a place in the source, no event time."""
    return rows.groupBy(*source).agg(F.max(id_col).alias("last_external_id"), F.count(F.lit(1)).alias("items_ingested"))


def hourly_counts(events: DataFrame, ts: str, kind: str, late: str = "2 hours") -> DataFrame:
    """Counts by hour and kind; rows later than `late` are left out."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, "1 hour"), kind).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("hour"), kind, "n")


def lockouts(failures: DataFrame, user: str, ts: str, most: int = 5, minutes: int = 15) -> DataFrame:
    """(user, locked_until) whenever a user's failures reach `most`; the count starts anew after the lock. Failures while locked do not count."""
    kind = failures.schema[user].dataType.simpleString()

    def step(key: tuple, frames, state: GroupState):
        n, until = state.get if state.exists else (0, 0)
        out = []
        for t in sorted(t for f in frames for t in pd.to_datetime(f[ts]).astype("int64")):
            if t < until:
                continue
            n += 1
            if n >= most:
                until, n = t + minutes * 60 * 10**9, 0
                out.append(until)
        state.update((n, until))
        yield pd.DataFrame({user: [key[0]] * len(out), "locked_until": pd.to_datetime(out)})

    every: Callable = failures.groupBy(user).applyInPandasWithState
    return every(step, f"{user} {kind}, locked_until timestamp", "n int, until bigint", "append", GroupStateTimeout.NoTimeout)
