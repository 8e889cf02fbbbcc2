"""Exact repeated passages by level-wise doubling.

A passage is a window of a fixed number of words. Level 0 looks at windows of half the wanted length or less, sampled by
winnowing: of each run of consecutive windows the one of least hash is kept, and the run is so short that every window of
the next length holds a kept one. Those whose hash is found in one document alone are out. Only windows of twice the length
around the survivors are hashed at the next level, and so on until the wanted length, or until none survive. A word goes if
a window over it, of the wanted length, also starts in a document of a smaller id.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import cut, enter, skew_join, small_batches
from ._words import BASE_CHECK, groups


def winnow(hashes: np.ndarray, reach: int) -> np.ndarray:
    """Places of the least of every `reach` neighbouring hashes (of equals the last); of fewer than that, the least of all."""
    if len(hashes) <= reach:
        return np.array([len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else [], np.int64)
    view = np.lib.stride_tricks.sliding_window_view(hashes[::-1], reach)
    return np.unique(len(hashes) - 1 - (np.arange(len(view)) + view.argmin(1)))


def _sampled(length: int, wanted: int):
    """Row key, hash and place of the sampled windows of `length` words, of texts that have `wanted` words."""
    reach = wanted - length + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            keys = batch.column(0)
            for first, last, words in groups(batch.column(2)):
                hashes, _ = words.windows(length)
                row, place, value = [], [], []
                for i in range(last - first):
                    a, b = words.bounds[i], words.bounds[i + 1]
                    if b - a >= wanted:
                        at = winnow(hashes[a : b - length + 1], reach)
                        row.append(np.full(len(at), first + i))
                        place.append(at)
                        value.append(hashes[a + at])
                if row:
                    row = np.concatenate(row)
                    yield pa.RecordBatch.from_pydict({"key": keys.take(pa.array(row)), "doc_id": batch.column(1).take(pa.array(row)), "hash": pa.array(np.concatenate(value).view(np.int64)), "place": pa.array(np.concatenate(place).astype(np.int32))})

    return run


def _around(length: int, inner: int):
    """Key, hash, check hash and place of the windows of `length` words that hold a surviving window of `inner` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            survivors = batch.column(3)
            for first, last, words in groups(batch.column(2)):
                hashes, _ = words.windows(length)
                checks, _ = words.windows(length, BASE_CHECK)
                row, place, value, check = [], [], [], []
                for i in range(last - first):
                    a, n = words.bounds[i], int(words.bounds[i + 1] - words.bounds[i])
                    at = np.asarray(survivors[first + i].values, np.int64)
                    if n >= length and len(at):
                        marks = np.zeros(n + 1, np.int32)
                        np.add.at(marks, np.maximum(at + inner - length, 0), 1)
                        np.add.at(marks, at + 1, -1)
                        at = np.flatnonzero(np.cumsum(marks)[: n - length + 1])
                        row.append(np.full(len(at), first + i))
                        place.append(at)
                        value.append(hashes[a + at])
                        check.append(checks[a + at] >> np.uint64(32))
                if row:
                    row = pa.array(np.concatenate(row))
                    yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(row), "doc_id": batch.column(1).take(row), "hash": pa.array(np.concatenate(value).view(np.int64)), "check": pa.array(np.concatenate(check).view(np.int64).astype(np.int32)), "place": pa.array(np.concatenate(place).astype(np.int32))})

    return run


def _removed(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("substrings")
        for batch in batches:
            n_words, n_gone, kept, digests = [], [], [], []
            for text, starts, copy in zip(batch.column(1), batch.column(2), batch.column(3)):
                words = text.as_py().encode().split()
                gone = np.zeros(len(words), bool)
                if copy.as_py() and len(words) >= length:
                    gone[:], words = True, []
                elif starts.is_valid and len(starts):
                    edge = np.zeros(len(words) + 1, np.int32)
                    at = np.asarray(starts.values, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, np.minimum(at + length, len(words)), -1)
                    gone = np.cumsum(edge)[: len(words)] > 0
                    words = [w for w, g in zip(words, gone) if not g]
                left = b" ".join(words)
                n_words.append(len(gone))
                n_gone.append(int(gone.sum()))
                kept.append(left.decode())
                digests.append(hashlib.sha256(left).hexdigest())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_gone, pa.int64()), "kept_sha256": pa.array(digests, pa.string()), "kept_text": pa.array(kept, pa.string())})

    return run


def remove_repeats(docs: DataFrame, length: int = 50, levels: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words joined by one space).

    levels: how often the first length is doubled to reach `length`, which must be divisible by 2**levels. Hashes have 64
    bits while windows are candidates and 96 at the wanted length. A key's rows are counted by partial aggregates before
    they are shuffled, and surviving windows find their counts by a sort-merge join whose large partitions Spark splits;
    texts are shuffled once. Of equal texts (by 128-bit hashes) one takes part, the rest go from end to end. Null text: no words. A null id is smaller than none and none is smaller, so that nothing is
    removed on either side; rows of one id do not remove from each other; repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.xxhash64(F.col(id_col), text).alias("key"), F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    inner = length >> levels
    if levels < 1 or inner << levels != length:
        raise ValueError("length must be divisible by 2 ** levels")
    # Of equal texts only the one of least id needs to be looked at: the others are covered by it from end to end.
    same = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("key"), F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))
    first = same.groupBy("a", "b").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    copies = cut(skew_join(same, first, ["a", "b"]).where("least < doc_id").select("key").distinct())
    # Row keys repeat only for equal rows (or by a hash accident within one id), whose windows are the same.
    found = rows.mapInArrow(_sampled(inner, 2 * inner), f"key bigint, doc_id {kind}, hash bigint, place int")
    repeated = found.groupBy("hash").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").select("hash")
    found = skew_join(found, repeated, ["hash"], "left_semi").join(copies, "key", "left_anti")
    for level in range(1, levels + 1):
        wide = inner * 2
        places = found.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("places"))
        found = rows.join(places, "key").select("key", "doc_id", "text", "places").mapInArrow(_around(wide, inner), f"key bigint, doc_id {kind}, hash bigint, check int, place int")
        least = found.groupBy("hash", "check").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
        if level < levels:
            found = skew_join(found, least.select("hash", "check"), ["hash", "check"], "left_semi")
        else:
            found = skew_join(found, least.select("hash", "check", "least"), ["hash", "check"]).where("least < doc_id")
        inner = wide
    starts = found.groupBy("key").agg(F.sort_array(F.collect_set("place")).alias("starts")).withColumn("copy", F.lit(False))
    starts = starts.unionByName(copies.select("key", F.lit(None).cast("array<int>").alias("starts"), F.lit(True).alias("copy")))
    return rows.join(starts, "key", "left").select("doc_id", "text", "starts", "copy").mapInArrow(_removed(length), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
