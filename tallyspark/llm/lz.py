"""Lempel-Ziv phrase fingerprints.

A text is parsed into dictionary phrases (each the longest phrase seen before plus one code point), the set of phrases is
hashed, and the least hashes of the set are its signature. The share of common least hashes estimates the Jaccard index of
the two phrase sets, which behaves like a compression distance: what one text's phrases say about the other.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._tables import enter, id_text, small_batches
from ._words import BASE_WORDS, inverse, mix, powers

#: Hashes in a signature; the most buckets that the order of documents is cut into, and rows in one while they are fewer.
SIGNATURE, MAX_BUCKETS, BUCKET_ROWS = 128, 8192, 1024
_SHIFT = 21
_code = np.random.default_rng(7).integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)


class Parse:
    """A parse that can be continued: the phrase dictionary, the phrase begun, and where phrases ended."""

    __slots__ = ("ends", "grow", "node", "trie")

    def __init__(self) -> None:
        self.trie: dict[int, int] = {}
        self.node, self.grow, self.ends = 0, 1 << _SHIFT, []

    def copy(self) -> Parse:
        other = Parse()
        other.trie, other.node, other.grow, other.ends = self.trie.copy(), self.node, self.grow, self.ends.copy()
        return other

    def read(self, codes: list[int], at: int) -> None:
        trie, node, grow, end, step = self.trie, self.node, self.grow, self.ends.append, 1 << _SHIFT
        known = trie.get
        for at, code in enumerate(codes, at + 1):  # noqa: B020
            key = node | code
            node = known(key, 0)
            if not node:
                trie[key] = grow
                grow += step
                end(at)
        self.node, self.grow = node, grow


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def signature(codes: np.ndarray, ends: list[int]) -> np.ndarray:
    """The least SIGNATURE hashes of the phrases, ascending; what follows the last end is a phrase too."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32)
    ends = np.asarray(ends if ends and ends[-1] == n else [*ends, n])
    starts = np.concatenate(([0], ends[:-1]))
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum((_code[codes & 4095] + codes.astype(np.uint64)) * powers(BASE_WORDS, n)[:n], out=prefix[1:])
    hashes = mix((prefix[ends] - prefix[starts]) * powers(inverse(BASE_WORDS), n)[starts]) >> np.uint64(32)
    hashes = np.unique(hashes.astype(np.uint32))
    return hashes[:SIGNATURE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard index from 0 to 1: of the least hashes of both together, the share in both. Two empty ones are equal."""
    if not len(a) and not len(b):
        return 1.0
    least = np.union1d(a, b)[:SIGNATURE]
    return float((np.isin(least, a, True) & np.isin(least, b, True)).sum() / len(least))


def to_string(hashes: np.ndarray) -> str:
    return base64.b64encode(hashes.astype("<u4").tobytes()).decode()


def fingerprint(text: str) -> np.ndarray:
    parse, codes = Parse(), codes_of(text)
    parse.read(codes.tolist(), 0)
    return signature(codes, parse.ends)


def _both(text: str, following: str) -> tuple[int, str, np.ndarray, np.ndarray]:
    """Length, edited text, and the signatures of the text and of the edited text; their common half is parsed once."""
    n = len(text)
    edited = text[: n - n // 2] + following[: n // 2]
    codes, changed, keep = codes_of(text), codes_of(edited), n - n // 2
    parse = Parse()
    parse.read(codes[:keep].tolist(), 0)
    other = parse.copy()
    parse.read(codes[keep:].tolist(), keep)
    other.read(changed[keep:].tolist(), keep)
    return n, edited, signature(codes, parse.ends), signature(changed, other.ends)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by bucket, then order, the copied first row of the following bucket last; each meets the one after it."""
    enter("lz")
    names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    kinds = (None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    held = None  # a row and, once known, nothing more: its result waits for the next row's signature
    waiting = None
    for batch in batches:
        rows: list[tuple] = []
        for i, (bucket, text, edge) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if held is not None and held[0] == bucket:
                n, edited, own, changed = _both(held[2], text)
                if waiting is not None:
                    rows.append((*waiting[:6], likeness(waiting[6], own)))
                waiting = (held[1], n, hashlib.sha256(edited.encode()).hexdigest(), to_string(own), to_string(changed), likeness(own, changed), own)
                if edge:
                    rows.append((*waiting[:6], likeness(waiting[6], fingerprint(text))))
                    waiting = None
            elif waiting is not None:
                raise RuntimeError("a bucket ended without its following row")
            held = None if edge else (bucket, batch.column(1)[i], text)
        if rows:
            yield pa.RecordBatch.from_pydict({name: pa.array([r[k].as_py() for r in rows], batch.schema.field(1).type) if kind is None else pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(zip(names, kinds))})


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one of the next smaller id, after the last the first. Ids are cut into at most MAX_BUCKETS
    ranges at approximate quantiles; a text goes once through a shuffle by range, is sorted there, and rows stream past
    their successors, so that no group is held in memory. The first row of each range is also sent to the range before it.
    Ids are numbers, of any size (ranges are cut by their doubles, rows are sorted by the ids themselves); a null id comes last, rows of one id by a hash of their texts. Null text: empty (signature of no
    phrases; two such are alike by 1). A table of one row is its own successor; an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = id_text(docs, id_col, text_col).select("doc_id", "text", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_order"), F.coalesce("doc_id", F.lit(0)).alias("_num"), F.xxhash64("text").alias("_tie"))
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ids = docs.select(F.coalesce(F.col(id_col).cast("double"), F.lit(-1.7e308)).alias("i"))
    total = ids.count()
    wanted = int(min(MAX_BUCKETS, max(1, total / BUCKET_ROWS, min(total / 32, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))))
    at = ids.agg(F.percentile_approx("i", [k / wanted for k in range(1, wanted)], 20 * MAX_BUCKETS).alias("at")).first()["at"] if wanted > 1 else None
    splits = [float("-inf"), *(sorted({x for x in at or () if x > -1.7e308}) or [0.0]), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket").transform(rows)
    # One row for each range, so at most MAX_BUCKETS + 1: the first in descending order, which the range above has last.
    firsts = sorted(docs.select(F.coalesce(F.col(id_col).cast("double"), F.lit(float("-inf"))).alias("_order"), F.coalesce(F.col(id_col), F.lit(0)).alias("_num"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_tie")).transform(Bucketizer(splits=splits, inputCol="_order", outputCol="_bucket").transform).groupBy("_bucket").agg(F.max(F.struct("_order", "_num", "_tie")).alias("top")).collect(), key=lambda r: r["_bucket"])
    if not firsts:
        return spark.createDataFrame([], schema)
    edges = spark.createDataFrame([(r["top"]["_order"], r["top"]["_num"], r["top"]["_tie"], firsts[(k + 1) % len(firsts)]["_bucket"]) for k, r in enumerate(firsts)], rows.select("_order", "_num", "_tie", F.col("_order").alias("_above")).schema)
    places = F.array_compact(F.array(F.struct(F.col("_bucket").alias("b"), F.lit(0).alias("edge")), F.when(F.col("_above").isNotNull(), F.struct(F.col("_above").alias("b"), F.lit(1).alias("edge")))))
    rows = rows.join(F.broadcast(edges), ["_order", "_num", "_tie"], "left").withColumn("_place", F.explode(places))
    rows = rows.select(F.col("_place.b").alias("bucket"), "doc_id", "text", F.col("_place.edge").alias("edge"), "_order", "_num", "_tie")
    rows = rows.repartition(max(1, min(len(firsts), int(spark.conf.get("spark.sql.shuffle.partitions")))), "bucket").sortWithinPartitions("bucket", "edge", F.desc("_order"), F.desc("_num"), F.desc("_tie"))
    return rows.select("bucket", "doc_id", "text", "edge").mapInArrow(_stream, schema)
