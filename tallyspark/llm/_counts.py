"""Counts by 64-bit key in sorted shards that tasks memory-map.

Tasks send partial counts; Spark sorts them by key over ranges; each range becomes a shard of two files in the shared
checkpoint folder, keys and counts, where rows of equal keys are summed as they pass. A shard is written under a name of its
own attempt and then moved to its final one, so a task that runs twice leaves one whole shard. The driver keeps a row for
each shard; lookups map the files and search them, so a worker holds the pages it touches, not the table.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ._tables import _written, checkpoint_dir, cut, spent

#: Rows of counts in one Arrow batch.
COUNT_ROWS = 1 << 16


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int):
    """What runs inside gets Arrow batches of so many rows: rows of counts are short, unlike texts."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def sum_sorted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of equal keys once, with the sum of its counts."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


class Partial:
    """Counts of a task: sorted keys with their sums, merged in whenever as much again has come."""

    def __init__(self, most: int = 1 << 21):
        self.keys, self.n, self.most = np.zeros(0, np.int64), np.zeros(0, np.int64), most
        self.new: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, keys: np.ndarray, n: np.ndarray | None = None) -> None:
        own, at = np.unique(keys, return_inverse=True)
        times = np.bincount(at, minlength=len(own)) if n is None else np.bincount(at, n, len(own))
        self.new.append((own, times.astype(np.int64)))
        self.waiting += len(own)
        if self.waiting > max(len(self.keys), 1 << 18):
            self._merge()

    def _merge(self) -> None:
        keys = np.concatenate([self.keys, *(k for k, _ in self.new)])
        n = np.concatenate([self.n, *(x for _, x in self.new)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.n = sum_sorted(keys[order], n[order])
        self.new, self.waiting = [], 0

    def full(self) -> bool:
        return len(self.keys) + self.waiting > self.most

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self._merge()
        out = self.keys, self.n
        self.keys, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        return out


@dataclass
class Shards:
    """Where the shards are: their first keys in order, rows, and the sum of all counts. notes: what the writer's extra() said of each."""

    folder: str
    names: list[str]
    firsts: np.ndarray
    rows: np.ndarray
    total: int
    notes: list[bytes] = field(default_factory=list)

    def open(self) -> Lookup:
        """For use in a task."""
        return Lookup(self.folder, self.names, self.firsts, self.rows)


class Lookup:
    def __init__(self, folder: str, names: list[str], firsts: np.ndarray, rows: np.ndarray):
        self.folder, self.names, self.firsts, self.rows = folder, names, firsts, rows
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            where, path = _folder(self.folder)
            files = [f"{path}/{self.names[k]}.{kind}" for kind in ("keys", "counts")]
            if isinstance(where, fs.LocalFileSystem):
                self.held[k] = tuple(np.memmap(f, np.int64, "r", shape=(int(self.rows[k]),)) for f in files)
            else:  # a store that cannot be mapped
                self.held[k] = tuple(np.frombuffer(where.open_input_file(f).readall(), np.int64) for f in files)
        return self.held[k]

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The counts of sorted keys, 0 where there is none."""
        out = np.zeros(len(keys), np.int64)
        if not len(self.firsts):
            return out
        ends = np.append(np.searchsorted(keys, self.firsts[1:]), len(keys))
        start = 0
        for k, end in enumerate(ends):
            if end > start:
                own, n = self._shard(k)
                at = np.minimum(np.searchsorted(own, keys[start:end]), len(own) - 1)
                out[start:end] = np.where(own[at] == keys[start:end], n[at], 0)
                start = end
        return out


def sorted_shards(partials: DataFrame, extra: Callable[[np.ndarray, np.ndarray], bytes] | None = None, written: bool = False) -> Shards:
    """The shards of partial counts (key bigint, n bigint), deleted with the other written tables.

    One shuffle, by ranges of the key; partial counts are written before, unless they come from a written table, as the ranges
    are found by a look at them. extra: what a task says of its sums, piece by piece as they pass; it should be short, as the driver keeps it.
    """
    spark = partials.sparkSession
    folder = f"{checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    _written.append(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = _folder(folder)
        name, last, first, rows, total, notes = uuid.uuid4().hex, None, None, 0, 0, []
        files = None
        for batch in _then_none(batches):
            if batch is not None and not len(batch):
                continue
            if batch is None:
                if last is None:
                    return
                keys, n = np.array([last[0]]), np.array([last[1]])
                last = None
            else:
                keys, n = sum_sorted(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                if last is not None:
                    if keys[0] == last[0]:
                        n[0] += last[1]
                    else:
                        keys, n = np.append(last[0], keys), np.append(last[1], n)
                last, keys, n = (keys[-1], n[-1]), keys[:-1], n[:-1]
            if not len(keys):
                continue
            if files is None:
                where.create_dir(path, recursive=True)
                files = [where.open_output_stream(f"{path}/{name}.{kind}.part") for kind in ("keys", "counts")]
                first = int(keys[0])
            for file, x in zip(files, (keys, n)):
                file.write(np.ascontiguousarray(x, np.int64).tobytes())
            rows, total = rows + len(keys), total + int(n.sum())
            if extra:
                notes.append(extra(keys, n))
        for file, kind in zip(files, ("keys", "counts")):
            file.close()
            where.move(f"{path}/{name}.{kind}.part", f"{path}/{name}.{kind}")
        yield pa.RecordBatch.from_pydict({"name": [name], "first": pa.array([first], pa.int64()), "rows": pa.array([rows], pa.int64()), "total": pa.array([total], pa.int64()), "note": pa.array([b"".join(notes)], pa.binary())})

    with batches_of(spark, COUNT_ROWS):
        held = partials if written else cut(partials)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranged = held.repartitionByRange(parts, "key").sortWithinPartitions("key")
        made = sorted(ranged.mapInArrow(run, "name string, first bigint, rows bigint, total bigint, note binary").collect(), key=lambda r: r["first"])
        if not written:
            spent(held)
    return Shards(folder, [r["name"] for r in made], np.array([r["first"] for r in made], np.int64), np.array([r["rows"] for r in made], np.int64), sum(r["total"] for r in made), [bytes(r["note"]) for r in made])


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
