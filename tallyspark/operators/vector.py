"""Vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str = "vec_id", column: str = "embedding", where: Column | None = None) -> DataFrame:
    """The k most similar vectors by cosine, ties by id: each task keeps its own k. Rows of undefined similarity come last, with null."""
    rows = vectors.where(where) if where is not None else vectors
    rows = rows.withColumn("similarity", F.round(cosine(F.col(column), F.array(*map(F.lit, map(float, query)))), 6))
    return rows.orderBy(F.desc_nulls_last("similarity"), F.asc(id_col)).limit(k).select(id_col, "similarity")


def page(vectors: DataFrame, query: list[float], skip: int, take: int, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """A page of the ranking and one row more; what lies behind that is not counted."""
    return top_k(vectors, query, skip + take + 1, id_col, column).orderBy(F.desc_nulls_last("similarity"), F.asc(id_col)).offset(skip)


def delete(vectors: DataFrame, **equal) -> DataFrame:
    rows = vectors
    for name, value in equal.items():
        rows = rows.where(~F.col(name).eqNullSafe(F.lit(value)))
    return rows


#: Queries compared with all vectors in one pass, and vectors compared with them at once: so many at most, and so many pairs.
BLOCK, ROWS, CELLS = 2048, 2048, 1 << 20


def search(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", column: str = "embedding", lists: tuple[str, dict] | None = None) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the k most similar vectors of each query (query_id, embedding) by cosine, ties by id.

    Where the similarity is undefined (a vector of no length or with a value that is no number, on either side) it is null, and
    such rows come last. Queries are a stated set, taken in blocks of BLOCK that are sent to the tasks; a task keeps its own k best of each query,
    and those of all tasks are ranked. lists: the column of a vector's list, and for each query id the lists it looks into.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    asked = queries.select("query_id", column).where(F.col(column).isNotNull()).orderBy("query_id").toArrow()
    out = None
    for low in range(0, max(1, len(asked)), BLOCK):
        block = asked.slice(low, BLOCK)
        ids = block.column(0).to_pylist()
        rows = vectors.where(F.col(column).isNotNull()).select(id_col, column, *([lists[0]] if lists else []))
        part = rows.mapInArrow(_best(ids, np.array(block.column(1).to_pylist(), float), k, [sorted(map(int, lists[1][i])) for i in ids] if lists else None), f"query_id bigint, {id_col} {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    out = out.dropDuplicates(["query_id", id_col]) if lists else out  # a vector may be in several lists
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), F.asc(id_col))
    return out.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _best(ids: list[int], asked: np.ndarray, k: int, lists: list[list[int]] | None):
    """Of the vectors of a task the k best of each query; a vector that is met twice counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not ids:
            return
        with np.errstate(all="ignore"):
            unit = asked / np.linalg.norm(asked, axis=1, keepdims=True)
        looks = None
        if lists:
            looks = np.zeros((1 + max(map(max, lists), default=0), len(ids)), bool)
            for q, own in enumerate(lists):
                looks[own, q] = True
        held, floor = (np.zeros(0, np.int64), np.zeros(0), None), np.full(len(ids), -np.inf)  # floor: the least of a query's k best
        size = max(1, min(ROWS, CELLS // len(ids)))
        name = kind = None
        for batch in batches:
            name, kind = batch.schema.field(0).name, batch.schema.field(0).type
            for low in range(0, len(batch), size):
                part = batch.slice(low, size)
                own = np.array(part.column(0).to_pylist())
                found = np.array(part.column(1).to_pylist(), float)
                with np.errstate(all="ignore"):
                    near = found @ unit.T
                    near /= np.linalg.norm(found, axis=1, keepdims=True)
                    np.round(near, 6, out=near)
                near[~np.isfinite(near)] = -np.inf  # undefined: behind all others
                seen = near >= floor
                if looks is not None:
                    listed = np.array(part.column(2).to_pylist())
                    inside = listed < len(looks)
                    seen[~inside] = False
                    seen[inside] &= looks[listed[inside]]
                if len(own) > k:  # all that may be among the k, with ties
                    least = np.partition(np.where(seen, near, -np.inf), len(own) - k, axis=0)[len(own) - k]
                    seen &= near >= least
                at, q = np.nonzero(seen)
                queries, scores = np.append(held[0], q), np.append(held[1], near[at, q])
                names = own[at] if held[2] is None else np.append(held[2], own[at])
                order = np.lexsort((names, -scores, queries))
                queries, scores, names = queries[order], scores[order], names[order]
                again = np.append(False, (queries[1:] == queries[:-1]) & (names[1:] == names[:-1]))
                queries, scores, names = queries[~again], scores[~again], names[~again]
                rank = np.arange(len(queries)) - np.searchsorted(queries, queries)
                held = queries[rank < k], scores[rank < k], names[rank < k]
                floor[queries[rank == k - 1]] = scores[rank == k - 1]
        if len(held[0]):
            scores = pa.array(held[1], pa.float64(), mask=~np.isfinite(held[1]))
            yield pa.RecordBatch.from_arrays([pa.array([ids[q] for q in held[0]], pa.int64()), pa.array(held[2].tolist(), kind), scores], names=["query_id", name, "similarity"])

    return run


class ListIndex:
    """Inverted lists: vectors by nearest of a number of centres fitted on a bounded sample; every vector is in a list."""

    SAMPLE = 50_000

    def __init__(self, vectors: DataFrame, lists: int = 100, id_col: str = "vec_id", column: str = "embedding", seed: int = 7):
        self.id_col, self.column = id_col, column
        rows = vectors.withColumn("_v", array_to_vector(F.transform(column, lambda x: x.cast("double"))))
        sample = rows.orderBy(F.xxhash64(id_col)).limit(self.SAMPLE)
        self.model = KMeans(k=lists, seed=seed, featuresCol="_v", predictionCol="list", maxIter=10).fit(sample)
        self.rows = self.model.transform(rows).drop("_v")

    def search(self, query: list[float], k: int, probes: int = 10) -> DataFrame:
        """The k most similar of the vectors in the lists whose centres are nearest to the query."""
        centres = self.model.clusterCenters()
        order = sorted(range(len(centres)), key=lambda i: float(((centres[i] - query) ** 2).sum()))[:probes]
        return top_k(self.rows.where(F.col("list").isin(order)), query, k, self.id_col, self.column)

    def search_all(self, queries: DataFrame, k: int, probes: int = 10) -> DataFrame:
        """As search() of this module for many queries, each looking into the lists whose centres are nearest to it."""
        centres = np.array(self.model.clusterCenters())
        asked = queries.select("query_id", self.column).toArrow()
        near = {i: np.argsort(((centres - np.array(q)) ** 2).sum(1), kind="stable")[:probes] for i, q in zip(asked.column(0).to_pylist(), asked.column(1).to_pylist())}
        return search(self.rows, queries, k, self.id_col, self.column, ("list", near))
