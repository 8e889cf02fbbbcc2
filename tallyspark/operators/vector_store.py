"""A stored vector index: lists as partition folders, with later writes and deletions beside them.

    path/log/00000007.json       one write each, in order; it counts once its file has been renamed to its name
    path/data/<name>/list=3/...  vectors of a write, by the list of the nearest centre
    path/gone/<name>/...         ids or documents that a write deletes

A row counts if no later write has its id, or deletes it or its document. A search reads only the folders of the lists it looks
into, and the ids of later writes. fold() writes all that counts as one new beginning; readers of older states are not
disturbed, as no file is changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..sources.commits import CommitLog
from . import vector


def _unit(rows: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        out = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    return np.where(np.isfinite(out), out, 0.0)


@dataclass
class VectorStore:
    """centres: unit vectors, one for each list. log: the writes, oldest first."""

    spark: SparkSession
    path: str
    centres: np.ndarray
    id_col: str
    doc_col: str
    column: str
    copies: int
    log: list[dict]

    #: Vectors that centres are fitted on.
    SAMPLE = 50_000

    # --- beginning

    @classmethod
    def create(cls, vectors: DataFrame, path: str, lists: int = 100, id_col: str = "vec_id", doc_col: str = "doc_id", column: str = "embedding", copies: int = 1, seed: int = 7) -> VectorStore:
        """A store of all rows of vectors, whose columns are kept. Centres are fitted on at most SAMPLE of them; copies: how many of the nearest lists hold a vector."""
        spark = vectors.sparkSession
        usable = vectors.where(F.col(column).isNotNull())
        sample = usable.orderBy(F.xxhash64(id_col)).limit(cls.SAMPLE).select(F.transform(column, lambda x: x.cast("double")).alias(column))
        sample = sample.where(F.aggregate(column, F.lit(0.0), lambda s, x: s + x * x) > 0)
        fitted = KMeans(k=lists, seed=seed, featuresCol="_v", distanceMeasure="cosine", maxIter=15).fit(sample.withColumn("_v", array_to_vector(column)))
        centres = _unit(np.array(fitted.clusterCenters()))
        out = cls(spark, path, centres, id_col, doc_col, column, min(copies, len(centres)), [])
        out._commit({"kind": "base", "data": out._write(vectors), "centres": centres.tolist(), "id": id_col, "doc": doc_col, "column": column, "copies": out.copies})
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        log = CommitLog(spark, f"{path}/log").entries()
        base = next(w for w in reversed(log) if w["kind"] == "base")
        return cls(spark, path, np.array(base["centres"]), base["id"], base["doc"], base["column"], base["copies"], [w for w in log if w["seq"] >= base["seq"]])

    # --- writing

    def _write(self, rows: DataFrame) -> str:
        """Rows by list, as a new folder. Null vectors and those without length go to list 0, where a scan finds them."""
        ship(self.spark)
        name, centres, copies = uuid.uuid4().hex, self.centres, self.copies
        schema = rows.schema
        at = schema.fieldNames().index(self.column)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = batch.column(at).to_pylist()
                known = np.array([v is not None for v in values], bool)
                lists = np.zeros((len(values), copies), np.int64)
                if known.any():
                    near = _unit(np.array([v for v in values if v is not None], float)) @ centres.T
                    lists[known] = np.argsort(-near, axis=1, kind="stable")[:, :copies]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.tolist(), pa.list_(pa.int32()))], names=[*batch.schema.names, "lists"])

        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        out = rows.mapInArrow(run, f"{kind}, lists array<int>").withColumn("list", F.explode("lists")).drop("lists")
        # a list's rows come from several tasks if there are many of them, so a large list does not meet in one
        spread = F.pmod(F.xxhash64(self.id_col), F.lit(max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(centres))))
        out.repartition("list", spread).write.partitionBy("list").parquet(f"{self.path}/data/{name}")
        return name

    def _commit(self, write: dict) -> None:
        """The write counts from here on; a Conflict means that another writer was quicker, and what was written lies unused."""
        self.log.append(CommitLog(self.spark, f"{self.path}/log").append(write, self.log[-1]["seq"] + 1 if self.log else 0))

    def upsert(self, rows: DataFrame) -> None:
        """Rows with new ids are added, those with known ids replace what is there. Ids are unique in rows, whose columns are those of the store."""
        self._commit({"kind": "upsert", "data": self._write(rows.select(*self._columns()))})

    def delete(self, keys: DataFrame) -> None:
        """Rows whose id or document is in keys, a table with the id or the document column."""
        by = next((c for c in (self.id_col, self.doc_col) if c in keys.columns), None)
        if by is None:
            raise ValueError(f"keys need a column {self.id_col} or {self.doc_col}")
        name = uuid.uuid4().hex
        keys.select(F.col(by).alias("key")).where(F.col("key").isNotNull()).distinct().write.parquet(f"{self.path}/gone/{name}")
        self._commit({"kind": "delete", "gone": name, "by": by})

    def replace_documents(self, rows: DataFrame) -> None:
        """All vectors of the documents in rows are those of rows: what they had before goes."""
        self.delete(rows.select(self.doc_col))
        self.upsert(rows)

    def fold(self) -> None:
        """All that counts as a new beginning, so that later reads look at one folder."""
        base = next(w for w in self.log if w["kind"] == "base")
        self._commit({**{k: v for k, v in base.items() if k != "seq"}, "data": self._write(self.rows())})
        self.log = self.log[-1:]

    # --- reading

    def _columns(self) -> list[str]:
        return [c for c in self._data(self.log[0]).columns if c != "list"]

    def _data(self, write: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/data/{write['data']}")

    def _listed(self, lists: list[int] | None = None) -> DataFrame:
        """Rows that count, of some lists or of all, with their list."""

        def read(write: dict) -> DataFrame:
            rows = self._data(write)
            return rows if lists is None else rows.where(F.col("list").isin(lists))

        out = None
        for write in (w for w in self.log if "data" in w):
            rows = read(write).withColumn("_seq", F.lit(write["seq"]))
            out = rows if out is None else out.unionByName(rows)
        later = [w for w in self.log if w["kind"] != "base"]
        for by in (self.id_col, self.doc_col):
            changed = None
            for write in later:
                if "data" in write and by == self.id_col:
                    one = self._data(write).select(F.col(by).alias("_key"))
                elif write.get("by") == by:
                    one = self.spark.read.parquet(f"{self.path}/gone/{write['gone']}").select(F.col("key").alias("_key"))
                else:
                    continue
                one = one.withColumn("_at", F.lit(write["seq"]))
                changed = one if changed is None else changed.unionByName(one)
            if changed is not None:
                last = changed.groupBy("_key").agg(F.max("_at").alias("_at"))
                out = out.join(last, (out[by] == last["_key"]) & (out["_seq"] < last["_at"]), "left_anti")
        return out.drop("_seq")

    def rows(self) -> DataFrame:
        """All rows that count, once each."""
        rows = self._listed()
        return (rows.drop("list") if self.copies == 1 else rows.dropDuplicates([self.id_col]).drop("list")).select(*self._columns())

    def nearest_lists(self, queries: DataFrame, probes: int) -> dict[int, list[int]]:
        """For each query the lists whose centres are most like it. Queries are a stated set, held by the driver."""
        asked = queries.where(F.col(self.column).isNotNull()).select("query_id", self.column).toArrow()
        if not len(asked):
            return {}
        near = _unit(np.array(asked.column(1).to_pylist(), float)) @ self.centres.T
        return dict(zip(asked.column(0).to_pylist(), np.argsort(-near, axis=1, kind="stable")[:, :probes].tolist()))

    def search(self, queries: DataFrame, k: int, probes: int) -> DataFrame:
        """(query_id, id, similarity, rank) as vector.search() over the lists nearest to each query; other lists' folders are not read. With as many probes as lists it is exact."""
        chosen = self.nearest_lists(queries, probes)
        lists = sorted({x for own in chosen.values() for x in own})
        return vector.search(self._listed(lists), queries, k, self.id_col, self.column, ("list", chosen))

    def read_share(self, queries: DataFrame, probes: int) -> float:
        """The mean share of all vectors that lie in the lists a query looks into."""
        sizes = {r["list"]: r["n"] for r in self._listed().groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each list
        chosen = self.nearest_lists(queries, probes)
        return float(np.mean([sum(sizes.get(x, 0) for x in own) for own in chosen.values()])) / max(1, sum(sizes.values()))
