"""Lines of the members of ZIP archives as a data source: a partition a member, read as a stream from the file system.

    spark.read.format("zip_lines").option("path", "/data/*.zip").option("member", "dir/FILE.TSV").load()

A task holds a few thousand lines, however large its member is. A member is a compressed stream, so it cannot be split; the
line numbers let a reader go on where the last one ended.
"""

from __future__ import annotations

import fnmatch
import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship

#: Lines in a batch, and bytes of a line beyond which it is given in a batch of its own.
LINES, LONG = 10_000, 1 << 20
SCHEMA = "path string, member string, line bigint, value string"


def member(names: list[str], wanted: str) -> str | None:
    """The name of a member: the very name, else one that ends in it after a slash, else one equal in any case."""
    if ".." in wanted or wanted.startswith("/"):
        raise ValueError("not a member name")
    for test in (lambda n: n == wanted, lambda n: n.endswith(f"/{wanted}"), lambda n: n.lower() == wanted.lower()):
        if found := next((n for n in names if test(n)), None):
            return found
    return None


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def archives(path: str) -> list[str]:
    """The files a path names: itself, those of a folder, or those that fit a pattern in its last part."""
    where, plain = located(path)
    head = path[: len(path) - len(plain)] if path.endswith(plain) else ""
    folder, _, last = plain.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f.path for f in where.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, last)]
    else:
        info = where.get_file_info(plain)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [plain] if info.type == fs.FileType.File else [f.path for f in where.get_file_info(fs.FileSelector(plain)) if f.type == fs.FileType.File]
    return [head + f for f in sorted(found)]


class Member(InputPartition):
    def __init__(self, path: str, name: str, first: int):
        self.path, self.name, self.first = path, name, first


class ZipLinesReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], options.get("member")
        self.largest = int(options.get("maxbytes", options.get("maxBytes", 1 << 42)))
        self.after = json.loads(options.get("after", "{}"))
        self.lines = int(options.get("lines", 1 << 62))

    def partitions(self) -> list[Member]:
        """A partition for each member asked for; an archive without it is an error."""
        out = []
        for path in archives(self.path):
            where, plain = located(path)
            with where.open_input_file(plain) as f, zipfile.ZipFile(f) as z:
                names = [i.filename for i in z.infolist() if not i.is_dir()]
                if self.wanted is not None:
                    found = member(names, self.wanted)
                    if found is None:
                        raise FileNotFoundError(f"{self.wanted} is not in {path}")
                    names = [found]
                for name in names:
                    if z.getinfo(name).file_size > self.largest:
                        raise ValueError(f"{name} is too large")
                    out.append(Member(path, name, int(self.after.get(f"{path}!{name}", 0))))
        return out

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        where, plain = located(partition.path)
        with where.open_input_file(plain) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as raw:
            lines: list[str] = []
            size, at = 0, partition.first
            for n, line in enumerate(io.TextIOWrapper(raw, "utf-8", errors="replace", newline="\n")):
                if n < partition.first:
                    continue
                if n >= partition.first + self.lines:
                    break
                line = line.rstrip("\r\n")
                lines.append(line)
                size += len(line)
                if len(lines) == LINES or size > LONG:
                    yield self._batch(partition, at, lines)
                    at, lines, size = at + len(lines), [], 0
            if lines:
                yield self._batch(partition, at, lines)

    @staticmethod
    def _batch(partition: Member, at: int, lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        same = lambda x: pa.array([x] * n, pa.string())
        return pa.RecordBatch.from_arrays([same(partition.path), same(partition.name), pa.array(range(at, at + n), pa.int64()), pa.array(lines, pa.string())], names=["path", "member", "line", "value"])


class ZipLines(DataSource):
    """Options: path (a file, a folder, or a pattern in the last part), member (all if it is not given), maxBytes (larger members are refused), after (JSON: from which line on, by `path!member`), lines (of a member at most)."""

    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipLinesReader:
        return ZipLinesReader(dict(self.options))


def read(spark: SparkSession, path: str, wanted: str | None = None, after: dict[str, int] | None = None, max_bytes: int | None = None, lines: int | None = None) -> DataFrame:
    """(path, member, line, value) of the members of the archives at path; after: from which line on, by `path!member`; lines: so many of each member at most."""
    ship(spark)
    spark.dataSource.register(ZipLines)
    asked = spark.read.format("zip_lines").option("path", path)
    for name, value in (("member", wanted), ("after", json.dumps(after) if after else None), ("maxBytes", max_bytes), ("lines", lines)):
        if value is not None:
            asked = asked.option(name, str(value))
    return asked.load()
