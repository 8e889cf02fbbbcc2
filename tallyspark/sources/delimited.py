"""Delimited text by the platform's own rules: lines are split at the delimiter without regard to quotes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_cell
from . import archive
from .archive import member  # noqa: F401  (was here before)

#: A member larger than this is refused.
MAX_MEMBER = 10 << 30


@dataclass
class Delimited:
    """headers: names of the cells in order. columns: source to target names. keep: cell values a row must have. key: cells of the composite key."""

    headers: list[str]
    columns: dict[str, str]
    delimiter: str = ","
    skip: int = 1
    keep: dict[str, str] = field(default_factory=dict)
    key: list[str] = field(default_factory=list)
    key_name: str = "external_id"


def parse(lines: DataFrame, config: Delimited, column: str = "value") -> DataFrame:
    """Rows of a frame of lines: cells cleaned, filtered, renamed; an empty cell is null, a row without any value goes.

    A filter on an unknown cell is ignored, a key on one is an error, and a row whose key cells are all empty goes.
    """
    at = {h: i for i, h in enumerate(config.headers)}
    if missing := [k for k in config.key if k not in at]:
        raise ValueError(f"key columns that are not in the file: {missing}")
    plain = config.delimiter if config.delimiter.isalnum() else f"\\{config.delimiter}" if config.delimiter != "\t" else "\t"
    cells = F.split(F.regexp_replace(column, "\r$", ""), plain, -1)
    cell = lambda h: F.nullif(clean_cell(F.get("_cells", F.lit(at[h]))), F.lit(""))
    rows = lines.where(F.trim(column) != "").withColumn("_cells", cells)
    for name, value in config.keep.items():
        if name in at:
            rows = rows.where(cell(name) == value)
    wanted = [cell(s).alias(t) for s, t in config.columns.items() if s in at]
    if config.key:
        rows = rows.where(F.coalesce(*[cell(k) for k in config.key]).isNotNull())
        wanted.append(F.concat_ws(":", *[F.coalesce(cell(k), F.lit("")) for k in config.key]).alias(config.key_name))
    out = rows.select(*wanted)
    return out.where(F.coalesce(*[F.col(t) for s, t in config.columns.items() if s in at]).isNotNull())


def read(spark: SparkSession, path: str, config: Delimited) -> DataFrame:
    """The files at path; the first config.skip lines of each file are left out, by their place. Files are read once and stay split; headings must lie in a file's first split."""
    if not config.skip:
        return parse(spark.read.text(path), config)
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), (F.col("_metadata.file_block_start") == 0).alias("first"))
    return parse(lines.mapInArrow(_without_heads(config.skip), "value string"), config)


def _without_heads(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: dict[str, int] = {}  # lines still to be dropped of each file that begins in this task
        for batch in batches:
            keep = np.ones(len(batch), bool)
            files, first = batch.column(1).dictionary_encode(), batch.column(2).to_numpy(zero_copy_only=False)
            for code, name in enumerate(files.dictionary.to_pylist()):
                more = left.setdefault(name, n)
                if more:
                    gone = np.flatnonzero((files.indices.to_numpy() == code) & first)[:more]
                    keep[gone] = False
                    left[name] = more - len(gone)
            yield batch.select(["value"]).filter(pa.array(keep))

    return run


def read_zip(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, line, value): lines of a member of every archive at path, a member to a task, streamed; each with its place, so that headings can be told."""
    return archive.read(spark, path, name, max_bytes=MAX_MEMBER).drop("member")
