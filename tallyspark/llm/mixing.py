"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is cut into blocks by a hash of its rows. What a source must give is a quota of blocks: whole passes over it,
and a part of one more pass that ends inside a block. A tree halves the output shards again and again and splits the quotas
of all sources between the halves by a multivariate hypergeometric draw, so that each shard ends with exact quotas whose
sum over shards is the total, distributed as if all blocks had been shuffled together. The blocks of a source are permuted
and dealt to the shards by these quotas, disjointly; rows are shuffled inside their shard.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, small_batches

WORD = r"[^\x20\x09-\x0D]+"
#: Bits of a row's hash, and of it those that give the block, and those resolved by each level of the search for a cut.
HASH_BITS, BLOCK_BITS, LEVEL_BITS, LEVELS = 60, 10, 12, 3
#: Passes over the rows left out that fill what one more whole row would overshoot.
FILLS = 2
#: Up to so many sources their table (a row each) is broadcast; beyond that it is joined by shuffling.
BROADCAST_SOURCES = 50_000
SEED = 11


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_hash(id_col: str, text_col: str, seed: int = SEED) -> Column:
    """What orders the rows of a source; equal rows have one."""
    return F.xxhash64(F.lit(seed), F.col(id_col), F.xxhash64(F.col(text_col)))


def targets(sources: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds target to (source, source_size): weights repeat over the sources by code point, null last.

    The shares of the total follow the weights, but no target is above `most` times its source's size, and the excess goes
    to the others by weight until none is above. That fixed point is least(most * size, level * weight) for one level: with
    the sources by size per weight, the level is found where the next source no longer reaches its limit.
    """
    named = Window.orderBy(F.asc_nulls_last("source"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("weight", weight).withColumn("limit", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("limit") / F.col("weight"), "weight", F.asc_nulls_last("source"))
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    weighs = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weighs).withColumn("full", F.col("limit") <= F.col("level") * F.col("weight"))
    level = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return rows.select("source", "source_size", F.when(F.col("full") | level.isNull(), F.col("limit")).otherwise(level * F.col("weight")).alias("target"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def _with(rows: DataFrame, per_source: DataFrame, n_sources: int, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has a row for each source; null sources meet."""
    right = _small(per_source.withColumnRenamed("source", "_source"), n_sources)
    return rows.join(right, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def _cut_hash(rows: DataFrame, goals: DataFrame, n_sources: int, nearest: bool) -> DataFrame:
    """For each source with a goal: the end of the hash below which its rows add up to no more than the goal or, if nearest, as near it as may be.

    rows: source, size, pos (hash); goals: source, goal. A level sums the sizes by the next bits of the hash inside the
    cell where the last level's sum passed the goal; partial sums are made before the shuffle, so that a large source is a
    few thousand rows. After the last level a cell is one row, or equal rows. Returns source, end; no row where all rows
    together do not pass the goal.
    """
    at = goals.select("source", F.col("goal").alias("rest"), F.lit(0).cast("long").alias("prefix"))
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = _with(rows, at, n_sources).where(F.shiftright("pos", shift + LEVEL_BITS) == F.col("prefix"))
        cells = inside.groupBy("source", F.shiftright("pos", shift).alias("cell")).agg(F.sum("size").alias("size"), F.first("rest").alias("rest"))
        upto = F.sum("size").over(Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
        cells = cells.withColumn("upto", upto)
        if level < LEVELS:
            at = cells.where("upto > rest").groupBy("source").agg(F.min(F.struct("cell", (F.col("rest") - F.col("upto") + F.col("size")).alias("rest"))).alias("m")).select("source", F.col("m.rest").alias("rest"), F.col("m.cell").alias("prefix"))
        else:
            near = F.lit(nearest) & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("upto") + F.col("size"))
            at = cells.where("upto > rest").groupBy("source").agg(F.min(F.struct("cell", near.alias("near"))).alias("m")).select("source", F.shiftleft(F.col("m.cell") + F.col("m.near").cast("long"), shift).alias("end"))
    return at


def _gaps(taken: DataFrame) -> DataFrame:
    """(source, gap) of the sources whose part of one more pass is too small yet."""
    got = taken.groupBy("source").agg(F.first("goal").alias("all"), F.sum(F.when(F.col("extra"), F.col("size")).otherwise(0)).alias("has"))
    return cut(got.select("source", (F.col("all") - F.col("has")).alias("gap")).where("gap > 0"))


def _with_nearest(taken: DataFrame, n_sources: int) -> DataFrame:
    """taken with one row more of each source that ends nearer to its goal by it: of the rows left out, of any size, that which comes nearest. Where equal rows make it too many words, none."""
    gaps = _gaps(taken)
    free = _with(taken.where(~F.col("extra") & (F.col("size") > 0)), gaps, n_sources).withColumn("off", F.abs(F.col("gap") - F.col("size"))).where("off < gap")
    best = cut(free.groupBy("source").agg(F.min(F.struct("off", "pos")).alias("m")).select("source", F.col("m.pos").alias("best")))
    own = _with(free, best, n_sources).where(F.col("pos") == F.col("best")).groupBy("source").agg(F.first("best").alias("best"), F.first("gap").alias("gap"), F.sum("size").alias("adds"))
    best = cut(own.where(F.abs(F.col("gap") - F.col("adds")) < F.col("gap")).select("source", "best"))
    one = F.coalesce((F.col("pos") == F.col("best")) & (F.col("size") > 0), F.lit(False))
    return cut(_with(taken, best, n_sources, "left").withColumn("extra", F.col("extra") | one).drop("best"))


def split_tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Quotas of each shard: rows are shards, columns sources. Shards get block totals that differ by one at most."""
    out = np.zeros((shards, len(quotas)), np.int64)

    def split(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle, total = (low + high) // 2, int(left.sum())
        take = total * (middle - low) // (high - low)
        rng = np.random.default_rng([seed, low, high])
        first = rng.multivariate_hypergeometric(left, take, method="marginals") if total else left
        split(low, middle, first)
        split(middle, high, left - first)

    split(0, shards, np.asarray(quotas, np.int64))
    return out


def _deal(shards: int, seed: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        counts = split_tree(rows["quota"].to_numpy(), shards, seed)
        ends = np.cumsum(counts, 0)
        return pd.DataFrame({"source": rows["source"], "ends": list(ends.T)})

    return run


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3, shards: int = 16, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each of docs: doc_id, source, size (words), source_size, target, copies (how often it is taken), taken
    (copies * size), row_hash (with the id it tells rows apart), shards array<int> (where each copy goes) and shuffle_key (order inside a shard).

    Equal rows and those of a hash are taken alike; reruns give the same. A null text has size 0, a null source is a source
    of its own, the last; a null id is an id. A source of no words has target 0 and its rows are not taken; an empty table
    gives no rows. Documents are read twice at most: ids, sizes and hashes are written to the shared checkpoint folder.
    Only tables of a row or 1024 for each source are joined to them; those of a row are broadcast up to BROADCAST_SOURCES.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), row_hash(id_col, text_col, seed).alias("row_hash"))
    rows = cut(rows.withColumn("pos", F.shiftrightunsigned("row_hash", 64 - HASH_BITS)))
    sources = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most).withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")))
    n = sources.count()
    sources = sources.withColumn("goal", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    # The part of one more pass: the rows below an end of the hash, then small rows of the others by the same search, then the one row that comes nearest.
    taken = _with(rows, sources, n).withColumn("extra", F.lit(False))
    for fill in range(FILLS + 1):
        fits = (F.col("size") > 0) & (F.col("size") * 4 <= F.col("gap")) if fill else F.col("size") > 0
        gaps = _gaps(taken)
        free = _with(taken.where(~F.col("extra")), gaps, n).where(fits).select("source", "size", "pos")
        ends = _cut_hash(free, gaps.withColumnRenamed("gap", "goal"), n, nearest=fill == FILLS)
        ends = cut(_with(gaps, ends, n, "left").withColumn("end", F.coalesce("end", F.lit(1 << HASH_BITS))))
        more = F.coalesce((F.col("pos") < F.col("end")) & fits, F.lit(False))
        taken = cut(_with(taken, ends, n, "left").withColumn("extra", F.col("extra") | more).drop("gap", "end"))
    taken = _with_nearest(taken, n)
    # Units are (source, pass, block); the last pass has those blocks of which a row is taken.
    taken = taken.withColumn("block", F.shiftright("pos", HASH_BITS - BLOCK_BITS).cast("int")).withColumn("copies", F.when(F.col("size") > 0, F.col("passes") + F.col("extra").cast("long")).otherwise(0))
    blocks = taken.groupBy("source", "block").agg(F.max("copies").alias("units")).where("units > 0")
    units = blocks.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("units") - 1)))
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64(F.lit(seed + 1), "pass", "block"), "pass", "block"))
    # One row for each source meets in one task: the draw at a node of the tree is over all sources at once.
    quotas = blocks.groupBy("source").agg(F.sum("units").alias("quota"))
    text = docs.schema[source_col].dataType.simpleString()
    dealt = quotas.groupBy(F.lit(0).alias("tree")).applyInPandas(_deal(shards, seed), f"source {text}, ends array<bigint>")
    units = _with(units.withColumn("place", place), dealt, n).withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("place"))))
    shards_of = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("units")).select(F.col("source").alias("_source"), F.col("block").alias("_block"), F.transform("units", lambda u: u["shard"]).alias("units"))
    out = taken.join(shards_of, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left")
    return out.select(
        "doc_id", "row_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"),
        F.slice(F.coalesce("units", F.array().cast("array<int>")), 1, F.col("copies").cast("int")).alias("shards"), F.xxhash64(F.lit(seed + 2), "pos").alias("shuffle_key"),
    )
