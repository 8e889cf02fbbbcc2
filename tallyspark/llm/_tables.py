"""Reading the input tables and small settings shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import of_application, ship

#: Rows in one Arrow batch sent to Python. Texts may be long, so a batch holds far fewer than Spark's default.
BATCH_ROWS = 256
_local: dict[str, str] = {}
_written: list[str] = []
_kept: dict[str, Callable[[], None]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_if_there(spark: SparkSession, sf_dir: str, name: str) -> DataFrame | None:
    """The table, or None where its folder has none of the name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
    return table(spark, sf_dir, name) if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path) else None


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Send the package to the executors, and bound the Arrow batches that Python tasks of this session get, so that memory follows the text, not the row count."""
    ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def enter(operator: str, drop: Callable[[], None] | None = None) -> None:
    """At the start of a Python task: workers live on from task to task, so what other operators have kept in this one is dropped; drop() is how to do that for this operator."""
    for other in [k for k in _kept if k != operator]:
        _kept.pop(other)()
    if drop:
        _kept[operator] = drop


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for written tables: spark.checkpoint.dir, or a temporary folder where that is unset and Spark runs in this process."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if "folder" not in _local:
            _local["folder"] = tempfile.mkdtemp(prefix="spark-tallyspark-")
        folder = _local["folder"]
    return of_application(spark, folder)


def cut(df: DataFrame) -> DataFrame:
    """The rows written once, as Parquet in the shared folder, and read from there afterwards: only the columns asked for, and small parts together in one task."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    _written.append(path)
    return out


def delete(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spent(*tables: DataFrame) -> None:
    """Delete what cut() wrote for these tables; nothing may be computed from them any more."""
    for table in tables:
        delete(table.sparkSession, table.written_to)
        _written.remove(table.written_to)


class Scratch:
    """What cut() writes inside the block is deleted at its end, when the results have been written elsewhere."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.first = len(_written)

    def __exit__(self, *error) -> None:
        delete(self.spark, *_written[self.first :])
        del _written[self.first :]


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, a null text as the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join that Spark may split where a key is very common on the left.

    It only does so where both sides come through a shuffle of the join's own. One that was just grouped by the key would
    be joined where it lies, so the join gets a further key, which follows from the others.
    """
    again = F.pmod(F.hash(*on), F.lit(2))
    return left.withColumn("_again", again).join(right.withColumn("_again", again), [*on, "_again"], how).drop("_again")


def some_texts(batches, chars: int = 1 << 20):
    """Column 0 and the texts of column 1 of a few rows at a time: about so many characters, or one text."""
    for batch in batches:
        texts = batch.column(1).to_pylist()
        first = 0
        while first < len(texts):
            last, size = first, 0
            while last < len(texts) and (last == first or size < chars):
                size += len(texts[last] or "")
                last += 1
            yield batch.column(0).slice(first, last - first), texts[first:last]
            first = last


def runs(batches, key: int = 0):
    """The rows of each run of equal keys, as one table each; the input comes sorted by the key column. Holds one run."""
    import pyarrow as pa

    held: list = []
    last = None
    for batch in batches:
        keys = batch.column(key).to_pylist()
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if i < len(keys):
                    if held:
                        yield pa.Table.from_batches(held).combine_chunks()
                    held, last, start = [], keys[i], i
    if held:
        yield pa.Table.from_batches(held).combine_chunks()
