"""Quality by hierarchical empirical Bayes.

A logistic classifier reads a document: hashed words and a few figures of style, fitted on a bounded sample of labelled
rows. What it says of all documents of a site and of each of the site's paths is aggregated; the site's mean is shrunk to
the global one, the path's to its site's, each with a prior strength estimated from how much the groups differ. The path's
posterior then moves the document's own log-odds. Groups of few rows say little and keep the prior; any group is a few sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._tables import cut, enter, small_batches
from ._words import Words, groups

#: Labelled rows fitted on at most (those of least hash of the id); hash places of words; figures of style; steps, penalty and easing of the fit; the fewest texts and the least share of a class's texts for a word place.
MAX_LABELS, PLACES, STYLES, STEPS, PENALTY, EASE, LEAST_TEXTS, LEAST_SHARE = 10_000, 1 << 16, 10, 300, 3e-2, 1e-5, 5, 0.02
#: Bounds of a prior's strength in documents, tables of sites broadcast up to so many rows, and the verdict's limits.
WEAKEST, STRONGEST, BROADCAST_ROWS = 2.0, 1e6, 200_000
MIN_QUALITY, MAX_TOXIC = 0.5, 0.75

_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[ord("A") : ord("Z") + 1] += 32
for _b in range(128):
    if not chr(_b).isalnum():
        _PLAIN[_b] = 32


def _share(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
    return (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def features(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct word places of the texts, one after another, how many each text has, and the figures of style."""
    plain = Words(_PLAIN[words.data], words.offsets)
    text = np.repeat(np.arange(len(plain.bounds) - 1, dtype=np.uint64), np.diff(plain.bounds))
    both = np.unique(text << np.uint64(32) | plain.hashes & np.uint64(PLACES - 1))
    sizes = np.bincount((both >> np.uint64(32)).astype(np.int64), minlength=len(words.bounds) - 1)
    d, o, n = words.data, words.offsets, np.diff(words.bounds)
    hashes, whole = words.windows(3)
    again = np.zeros(len(n))
    for i, (a, b) in enumerate(zip(words.bounds[:-1], words.bounds[1:])):
        if b - a > 3:
            again[i] = 1 - len(np.unique(hashes[a : b - 2])) / (b - a - 2)
    is_in = lambda chars: np.isin(d, np.frombuffer(chars, np.uint8))
    style = np.stack([np.log1p(n), np.diff(o) / np.maximum(n, 1), _share(is_in(b"#*$%&"), o), _share(is_in(b"|<>{}[]"), o), _share(is_in(b"!?"), o), _share((d >= 65) & (d <= 90), o), _share((d >= 48) & (d <= 57), o), _share(d == 10, o), again, sizes / np.maximum(np.diff(plain.bounds), 1)], 1)
    return (both & np.uint64(PLACES - 1)).astype(np.int32), sizes, style


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enter("site_quality")
    for batch in batches:
        for first, last, words in groups(batch.column(0)):
            places, sizes, style = features(words)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(places))
            yield pa.RecordBatch.from_pydict({"places": lists, "style": pa.array(list(style))} | {name: batch.column(k).slice(first, last - first) for k, name in enumerate(("quality", "toxic", "by", "tie"), 1)})


class Classifier:
    """Logistic regression on word places and figures of style."""

    def __init__(self, style_mean: np.ndarray, style_scale: np.ndarray):
        self.mean, self.scale = style_mean, style_scale
        self.words, self.style, self.base = np.zeros(PLACES), np.zeros(STYLES), 0.0

    def log_odds(self, places: np.ndarray, sizes: np.ndarray, style: np.ndarray) -> np.ndarray:
        row = np.repeat(np.arange(len(sizes)), sizes)
        return np.bincount(row, self.words[places], len(sizes)) + ((style - self.mean) / self.scale) @ self.style + self.base

    @classmethod
    def fit(cls, places: np.ndarray, sizes: np.ndarray, style: np.ndarray, label: np.ndarray) -> Classifier:
        """Adagrad over the whole sample; a class that never occurs leaves the prior only."""
        own = cls(style.mean(0), np.maximum(style.std(0), 1e-6))
        own.base = float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1)))
        if not 0 < label.sum() < len(label):
            return own
        row, scaled = np.repeat(np.arange(len(sizes)), sizes), (style - own.mean) / own.scale
        seen = np.zeros(PLACES, bool)  # places in too few texts of either class say nothing
        for kind in (0, 1):
            seen |= np.bincount(places[label[row] == kind], minlength=PLACES) >= max(LEAST_TEXTS, LEAST_SHARE * (label == kind).sum())
        # only the places that may get a weight are looked at, which leaves the result as it is
        held = seen[places]
        row, at, n_seen = row[held], (np.cumsum(seen) - 1)[places[held]], int(seen.sum())
        weights, sums = np.zeros(n_seen), [np.full(n_seen, EASE), np.full(STYLES, EASE), EASE]  # rare words move by their gradient, not by its sign
        weight = np.where(label == 1, 0.5 / label.mean(), 0.5 / (1 - label.mean())) if label.mean() < 0.5 else np.ones(len(label))
        for _ in range(STEPS):
            odds = np.bincount(row, weights[at], len(sizes)) + scaled @ own.style + own.base
            off = weight * (_sigmoid(odds) - label) / len(label)
            grads = [np.bincount(at, off[row], n_seen) + PENALTY * weights / 10, scaled.T @ off + PENALTY * own.style / 10, float(off.sum())]
            for k, g in enumerate(grads):
                sums[k] = sums[k] + g * g
            weights -= 0.3 * grads[0] / np.sqrt(sums[0])
            own.style -= 0.3 * grads[1] / np.sqrt(sums[1])
            own.base -= 0.3 * grads[2] / np.sqrt(sums[2])
        own.words[seen] = weights
        return own


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_classifiers(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MAX_LABELS) -> dict[str, Classifier]:
    """Classifiers of quality and toxic from at most `most` labelled rows. Only word places and figures reach the driver."""
    by = F.xxhash64("_id")
    sample = labels.select(F.col("doc_id").alias("_id"), F.coalesce("quality", F.lit(1)).cast("long").alias("_quality"), F.coalesce("toxic", F.lit(0)).cast("long").alias("_toxic"))
    sample = sample.orderBy(by, "_id", "_quality", "_toxic").limit(most)
    text = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    rows = text.join(F.broadcast(sample), F.col("_doc") == F.col("_id")).select("_text", "_quality", "_toxic", by.alias("by"), F.xxhash64("_text").alias("tie"))
    read = rows.mapInArrow(_read, "places array<int>, style array<double>, quality bigint, toxic bigint, by bigint, tie bigint")
    table = read.orderBy("by", "tie", "quality", "toxic").limit(most).toArrow()  # more only where ids repeat
    lists = table.column("places").combine_chunks()
    if not len(table):
        empty = np.zeros((1, STYLES))
        return {k: Classifier(empty[0], empty[0] + 1) for k in ("quality", "toxic")}
    sizes, places = np.diff(np.asarray(lists.offsets)), np.asarray(lists.values)
    style = np.asarray(table.column("style").combine_chunks().values).reshape(-1, STYLES)
    return {k: Classifier.fit(places, sizes, style, table.column(k).to_numpy()) for k in ("quality", "toxic")}


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("site_quality")
        for batch in batches:
            for first, last, words in groups(batch.column(1)):
                places, sizes, style = features(words)
                odds = {k: pa.array(np.clip(m.log_odds(places, sizes, style), -30, 30)) for k, m in shared.value.items()}
                pick = lambda k: batch.column(k).slice(first, last - first)
                yield pa.RecordBatch.from_pydict({"doc_id": pick(0), "site": pick(2), "path": pick(3)} | odds)

    return run


def _strength(groups_: DataFrame, middle: Column) -> float:
    """Documents that a prior is worth: by moments, mean(1 - mean) over the variance between groups that noise does not explain."""
    got = groups_.where("n > 1").agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - middle, 2)).alias("between"), F.sum((F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("noise"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum("s").alias("s")).first()
    if not got["n"] or got["k"] < 2:
        return STRONGEST
    mean, excess = got["s"] / got["n"], max(0.0, (got["between"] - got["noise"]) / got["n"])
    return float(min(STRONGEST, max(WEAKEST, mean * (1 - mean) / excess - 1))) if excess > 0 else STRONGEST


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Site and path for score_documents() from an address: its host in lower case, and the first part of its path."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z]+://([^/?#:]*)", 1))
    return host, F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*/([^/?#]*)", 1)


def score_documents(docs: DataFrame, labels: DataFrame, site: Column, path: Column, id_col: str = "doc_id", text_col: str = "text", min_quality: float = MIN_QUALITY, max_toxic: float = MAX_TOXIC, most_labels: int = MAX_LABELS) -> DataFrame:
    """For each row: doc_id, doc_quality (classifier alone), site_quality and path_quality (posteriors from the other documents), quality (combined),
    toxic, kept (quality at or above min_quality and toxic below max_toxic).

    Texts are not shuffled. Null text: empty. A null site or path is a group of its own; null ids stay null; repeated rows
    give repeated results; labels of unknown ids, and null labels (taken as good, not toxic), do no harm; without labels all
    scores are the prior. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    models = spark.sparkContext.broadcast(fit_classifiers(docs, labels, id_col, text_col, most_labels))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), site.cast("string").alias("site"), path.cast("string").alias("path"))
    scored = cut(rows.mapInArrow(_score(models), f"doc_id {docs.schema[id_col].dataType.simpleString()}, site string, path string, quality double, toxic double"))
    p = 1 / (1 + F.exp(-F.col("quality")))
    paths = cut(scored.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"), F.sum(p * p).alias("ss")))
    sites = cut(paths.groupBy("site").agg(*[F.sum(c).alias(c) for c in ("n", "s", "ss")]))
    whole = sites.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    middle = min(max(((whole["s"] or 0) + 1) / ((whole["n"] or 0) + 2), 1e-6), 1 - 1e-6)
    strong = _strength(sites, F.lit(middle))
    sites = sites.select(F.col("site").alias("_site"), F.col("n").alias("site_n"), F.col("s").alias("site_s"), (F.col("s") / F.col("n")).alias("mean"))
    named = paths.join(sites, F.col("site").eqNullSafe(F.col("_site")))
    deep = _strength(named, F.col("mean"))
    table = cut(named.select("_site", F.col("path").alias("_path"), "site_n", "site_s", F.col("n").alias("path_n"), F.col("s").alias("path_s")))
    if table.count() <= BROADCAST_ROWS:
        table = F.broadcast(table)
    out = scored.join(table, F.col("site").eqNullSafe(F.col("_site")) & F.col("path").eqNullSafe(F.col("_path")), "left")
    # A document is no evidence about itself: its own share is taken out of what its site and path say.
    out = out.withColumn("site_quality", (F.col("site_s") - p + strong * middle) / (F.col("site_n") - 1 + strong))
    out = out.withColumn("path_quality", (F.col("path_s") - p + deep * F.col("site_quality")) / (F.col("path_n") - 1 + deep))
    odds = F.col("quality") + _logit(F.least(F.greatest("path_quality", F.lit(1e-9)), F.lit(1 - 1e-9))) - _logit(F.lit(middle))
    out = out.select("doc_id", p.alias("doc_quality"), "site_quality", "path_quality", (1 / (1 + F.exp(-odds))).alias("quality"), (1 / (1 + F.exp(-F.col("toxic")))).alias("toxic"))
    return out.withColumn("kept", (F.col("quality") >= min_quality) & (F.col("toxic") < max_toxic))
