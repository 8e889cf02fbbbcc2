"""A log of commits in a shared folder: each is a small file that appears whole or not at all, under the next number."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer has taken the number; read the log again and decide anew."""


class CommitLog:
    """Entries are JSON objects; seq is their number, from 0."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _at(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def entries(self) -> list[dict]:
        """All entries, oldest first."""
        files, folder = self._at("")
        if not files.exists(folder):
            return []
        names = sorted(s.getPath().toString() for s in files.listStatus(folder) if s.getPath().getName().endswith(".json"))
        if not names:
            return []
        found = [json.loads(r["value"]) for r in self.spark.read.option("wholetext", True).text(names).collect()]  # a short text for each write
        return sorted(found, key=lambda e: e["seq"])

    def append(self, entry: dict, seq: int) -> dict:
        """Write the entry as number seq: it counts from the moment its file has its name, and the name can be taken once only."""
        entry = {**entry, "seq": seq}
        files, temporary = self._at(f".{uuid.uuid4().hex}")
        _, final = self._at(f"{seq:08d}.json")
        out = files.create(temporary)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if files.exists(final) or not files.rename(temporary, final):
            files.delete(temporary, False)
            raise Conflict(f"number {seq} of {self.path} is taken")
        return entry


def remove(spark: SparkSession, *paths: str) -> None:
    for name in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no folder."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(where)) if files.exists(where) else []
