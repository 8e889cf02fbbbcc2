"""JSON pages, GeoJSON, routing of records, text blocks, archives and crawl frontiers."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import parse_date
from ..functions.text import canonical_url, links
from ..operators.merge import free
from ..session import shared_folder

SOURCES: dict = {}


def source(kind: str):
    """Registers a reader for a kind of source; read_source() finds it by the config's type."""

    def register(f):
        SOURCES[kind] = f
        return f

    return register


def read_source(spark: SparkSession, config: dict) -> DataFrame:
    if config["type"] not in SOURCES:
        raise ValueError(f"unknown type of source: {config['type']}")
    return SOURCES[config["type"]](spark, config)


def substitute(text: str, values: dict[str, str]) -> str:
    """${name} replaced; unknown names stay."""
    return re.sub(r"\$\{(\w+)\}", lambda m: values.get(m[1], m[0]), text)


@source("api")
def json_pages(spark: SparkSession, config: dict) -> DataFrame:
    """Saved API pages: the array at a dotted path of each page, one row for each item, fields renamed.

    Items come as variants' text; `fields` gives their types. An item without any field goes.
    """
    pages = spark.read.option("wholetext", True).text(config["path"]).select(F.col("value"))
    path = "$." + config.get("results", "results")
    items = pages.select(F.explode(F.from_json(F.get_json_object("value", path), "array<string>")).alias("item"))
    rows = items.select(F.from_json("item", ", ".join(f"`{k}` {v}" for k, v in config["fields"].items())).alias("r")).select("r.*")
    rows = rows.where(F.coalesce(*[F.col(f"`{k}`").cast("string") for k in config["fields"]]).isNotNull())
    return rows.withColumnsRenamed(config.get("rename", {}))


@source("geojson")
def features(spark: SparkSession, config: dict) -> DataFrame:
    """Features of GeoJSON pages: properties as a map and the rings of polygons."""
    pages = spark.read.option("wholetext", True).text(config["path"])
    kind = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    rows = pages.select(F.explode(F.from_json("value", kind)["features"]).alias("f")).select("f.properties", "f.geometry")
    one, many = (F.from_json("geometry.coordinates", t) for t in ("array<array<array<double>>>", "array<array<array<array<double>>>>"))
    rings = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", F.flatten(many))
    return rows.select("properties", F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("rings"))


def template(pattern: str, properties: str = "properties") -> Column:
    """A text with {name} replaced by the property of that name; null where one is missing."""
    parts = re.split(r"\{(\w+)\}", pattern)
    return F.concat(*[F.lit(p) if k % 2 == 0 else F.col(properties)[p] for k, p in enumerate(parts)])


def route(rows: DataFrame, rules: list[tuple[str, list[str]]]) -> DataFrame:
    """Adds bucket: the first rule whose fields a record has (all of them); null where none fits."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, fields in rules:
        has = F.lit(True)
        for f in fields:
            has = has & (F.col(f).isNotNull() if f in rows.columns else F.lit(False))
        out = out.when(has, name)
    return rows.withColumn("bucket", out)


@dataclass
class Blocks:
    """Rules for text blocks: where the section begins and ends, lines left out, what parts blocks, and a pattern for each field."""

    delimiter: str
    fields: dict[str, str]
    start: str | None = None
    end: str | None = None
    skip: str | None = None
    defaults: dict[str, str] = field(default_factory=dict)
    required: list[str] = field(default_factory=list)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, rules: Blocks) -> DataFrame:
    """One row for each block: id, block number, and the first group of each field's pattern, its default, or null."""
    text = F.col(text_col)
    if rules.start:
        text = F.regexp_replace(text, rf"(?s)^.*?(?:{rules.start})", "")
    if rules.end:
        text = F.regexp_replace(text, rf"(?s)(?:{rules.end}).*$", "")
    if rules.skip:
        text = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~x.rlike(rules.skip)), "\n")
    rows = docs.select(id_col, F.posexplode(F.filter(F.split(text, f"(?m){rules.delimiter}"), lambda b: F.trim(b) != "")).alias("block", "_b"))
    for name, pattern in rules.fields.items():
        rows = rows.withColumn(name, F.coalesce(F.nullif(F.trim(F.regexp_extract("_b", pattern, 1)), F.lit("")), F.lit(rules.defaults.get(name))))
    for name in rules.required:
        rows = rows.where(F.col(name).isNotNull())
    return rows.drop("_b")


def archive(listing: DataFrame, url: str, pattern: str, newest: Column | None, most: int | None = None) -> DataFrame:
    """Archived files newer than the watermark by the date in their names, oldest first, at most so many of the newest."""
    rows = listing.withColumn("date", parse_date(F.regexp_extract(url, pattern, 1))).where(F.col("date").isNotNull())
    rows = rows.where(F.col("date") > newest) if newest is not None else rows
    if most is not None:
        rows = rows.orderBy(F.desc("date"), F.asc(url)).limit(most)
    return rows.orderBy(F.asc("date"), F.asc(url))


def enrich(rows: DataFrame, details: DataFrame, on: str) -> DataFrame:
    """Missing values of rows filled from their detail pages; values that are there stay."""
    own = {c: free(f"_{c}", rows, details) for c in details.columns if c != on}
    out = rows.join(details.withColumnsRenamed(own), on, "left")
    for c, other in own.items():
        out = out.withColumn(c, F.coalesce(c, other) if c in rows.columns else F.col(other))
    return out.drop(*own.values())


def crawl(pages: DataFrame, start: DataFrame, url: str = "url", html: str = "html", depth: int = 2, prefixes: list[str] | None = None, below: bool = False, most: int | None = None) -> DataFrame:
    """(url, depth) of pages reached by links from the start pages, within the start pages' hosts; if given, below one of the path prefixes, or below the folder of a start page of the host.

    Each round joins the new frontier with saved pages and is written to the shared folder, so that a round costs what it finds and not all rounds before it. most: so
    many pages at most, the nearest first, of one depth by address.
    """
    spark = pages.sparkSession
    folder = shared_folder(spark)
    host = lambda c: F.regexp_extract(c, r"^(https?://[^/?#]*)", 1)
    first = start.select(canonical_url(F.col(url)).alias("url")).distinct()
    path = lambda c: F.regexp_extract(c, r"^https?://[^/?#]*([^?#]*)", 1)
    hosts = first.groupBy(host(F.col("url")).alias("host")).agg(F.collect_set(F.regexp_replace(path(F.col("url")), "[^/]*$", "")).alias("folders"))
    targets = pages.select(canonical_url(F.col(url)).alias("from"), F.explode(F.transform(links(F.col(html), F.col(url)), canonical_url)).alias("to")).distinct()
    targets = targets.withColumn("host", host(F.col("to"))).join(hosts, "host")
    inside = lambda folders: F.exists(folders, lambda p: F.startswith(path(F.col("to")), p))
    if prefixes:
        targets = targets.where(inside(F.array(*map(F.lit, prefixes))))
    if below:
        targets = targets.where(inside(F.col("folders")))
    targets.select("from", "to").write.parquet(f"{folder}/targets")
    targets = spark.read.parquet(f"{folder}/targets")
    first.withColumn("depth", F.lit(0)).write.parquet(f"{folder}/0")
    for d in range(1, depth + 1):
        known = spark.read.parquet(*(f"{folder}/{k}" for k in range(d)))
        frontier = spark.read.parquet(f"{folder}/{d - 1}").select(F.col("url").alias("from"))
        found = targets.join(frontier, "from").select(F.col("to").alias("url")).distinct().join(known, "url", "left_anti")
        found.withColumn("depth", F.lit(d)).write.parquet(f"{folder}/{d}")
    reached = spark.read.parquet(*(f"{folder}/{k}" for k in range(depth + 1)))
    return reached if most is None else reached.orderBy("depth", "url").limit(most)


def accumulated(spark: SparkSession, configs: list[dict], name: str = "source") -> tuple[DataFrame | None, dict[str, str]]:
    """Rows of several sources with the source's name, and for each source that cannot be read what is wrong with it: one source's failure costs the others nothing.

    A source is read as far as its columns here; sources of other columns are filled with nulls.
    """
    out, failed = None, {}
    for config in configs:
        try:
            rows = read_source(spark, config)
            rows.schema  # the path and the columns are looked at now, not when the result is asked for
        except Exception as error:  # noqa: BLE001  whatever a source does wrong, the others go on
            failed[config[name]] = f"{type(error).__name__}: {error}"[:300]
            continue
        rows = rows.withColumn(name, F.lit(config[name]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out, failed
