"""JSON in texts: balanced objects and truncated answers."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

_FENCE = re.compile(r"^\s*```\w*\s*|\s*```\s*$")


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text, fences and prose left out; null where none closes."""
    if text is None:
        return None
    text = _FENCE.sub("", text)
    begin = text.find("{")
    depth, quoted, skip = 0, False, False
    for at in range(max(begin, 0), len(text) if begin >= 0 else 0):
        c = text[at]
        if skip:
            skip = False
        elif quoted:
            skip, quoted = c == "\\", c != '"'
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[begin : at + 1]
    return None


def salvage(text: str | None, name: str, least: int = 20) -> str | None:
    """A string field of an object that may be cut off, if at least so long."""
    m = re.search(rf'"{re.escape(name)}"\s*:\s*"((?:[^"\\]|\\.)*)', text or "", re.S)
    if not m or len(m[1]) < least:
        return None
    try:
        return json.loads(f'"{m[1]}"', strict=False)
    except ValueError:
        return m[1]


def json_field(json_text: Column, path: str) -> Column:
    """A field of a JSON object as text, by its name or dotted path; null where it is missing or the text is no JSON."""
    return F.get_json_object(json_text, f"$.{path}")


def json_slice(text: Column) -> Column:
    """first_object() of a column, in Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return F.pandas_udf(run, StringType())(text)


def answer(text: Column) -> Column:
    """answer and confidence of a model's reply; the whole text where it is no such object."""
    got = F.from_json(json_slice(text), "answer string, confidence double")
    return F.struct(F.coalesce(got["answer"], text).alias("answer"), F.coalesce(got["confidence"], F.lit(0.0)).alias("confidence"))


def string_array(json_text: Column, path: str) -> Column:
    """The strings of an array inside a JSON text, other values left out."""
    return F.filter(F.coalesce(F.from_json(F.get_json_object(json_text, path), "array<string>"), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def first_string(json_text: Column) -> Column:
    """The first text of a JSON value: of a text itself, of an array its first text, of an object its name or value."""
    inside = F.filter(F.from_json(json_text, "array<string>"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    named = F.coalesce(*[F.get_json_object(json_text, f"$.{k}") for k in ("name", "value", "text")])
    bare = F.when(json_text.rlike(r"^\s*[\[{]"), None).otherwise(F.regexp_replace(F.trim(json_text), '^"|"$', ""))
    return F.nullif(F.coalesce(F.when(json_text.rlike(r"^\s*\["), F.get(inside, F.lit(0))), F.when(json_text.rlike(r"^\s*\{"), named), bare), F.lit(""))


def status_fields(html: Column) -> Column:
    """struct<last_action, last_action_date> of a bill's status page: the span that is named so, and the first row of its history; years of two digits are of this century."""
    part = lambda k: F.regexp_extract(html, r"(?i)<span\s+id=\"lastAction\"[^>]*>\s*(\d{1,2})/(\d{1,2})/(\d{2,4})\s*<", k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    date = F.try_to_date(F.when(part(1) != "", F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"))), "yyyy-MM-dd")
    row = F.regexp_extract(html, r"(?i)<td\s+scope=\"row\">[^<]*</td>\s*<td>([^<]*)<", 1)
    said = F.trim(F.regexp_replace(F.replace(F.replace(row, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")), r"\s+", " "))
    return F.struct(F.nullif(said, F.lit("")).alias("last_action"), date.alias("last_action_date"))


def claims(json_text: Column, size: Column, kinds: tuple[str, ...]) -> Column:
    """Claims of a JSON array that have a title and a known kind, with their spans cut to the text and empty spans left out."""
    rows = F.from_json(json_text, "array<struct<kind: string, title: string, severity: string, start: int, end: int>>")
    rows = F.transform(rows, lambda c: F.struct(F.lower(F.trim(c["kind"])).alias("kind"), F.trim(c["title"]).alias("title"), F.nullif(F.trim(c["severity"]), F.lit("")).alias("severity"), F.greatest(c["start"], F.lit(0)).alias("start"), F.least(c["end"], size).alias("end")))
    return F.coalesce(F.filter(rows, lambda c: c["kind"].isin(*kinds) & (c["title"] != "") & (c["end"] > c["start"])), F.array().cast("array<struct<kind: string, title: string, severity: string, start: int, end: int>>"))


def mask_email(c: Column) -> Column:
    """First and last character of the local part, and the domain; a short local part is masked wholly."""
    local, domain = F.split(c, "@")[0], F.get(F.split(c, "@"), F.lit(1))
    n = F.length(local)
    masked = F.when(n > 2, F.concat(F.left(local, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(local, F.lit(1)))).otherwise(F.repeat(F.lit("*"), n))
    return F.when((local != "") & (F.coalesce(domain, F.lit("")) != ""), F.concat(masked, F.lit("@"), domain)).otherwise("[REDACTED_EMAIL]")


def mask_ip(c: Column) -> Column:
    parts = F.split(c, r"\.", -1)
    return F.when(F.size(parts) == 4, F.concat(parts[0], F.lit(".x.x.x"))).otherwise("[REDACTED_IP]")


def mask_fields(rows, hidden: tuple[str, ...], partly: dict[str, Callable[[Column], Column]], depth: int = 10):
    """Rows with the named fields masked at any level of structs and arrays of structs, down to `depth`: hidden ones wholly, others by their function. Names are compared in lower case."""
    from pyspark.sql.types import StructType

    def masked(c: Column, kind, left: int) -> Column:
        if not left:
            return c
        if isinstance(kind, StructType):
            return F.when(c.isNotNull(), F.struct(*[named(c[f.name], f, left - 1).alias(f.name) for f in kind.fields]))
        if isinstance(kind, ArrayType):
            return F.transform(c, lambda x: masked(x, kind.elementType, left - 1))
        return c

    def named(c: Column, f, left: int) -> Column:
        low = f.name.lower()
        if low in hidden:
            return F.when(c.isNotNull(), F.lit("[REDACTED]"))
        return partly[low](c) if low in partly else masked(c, f.dataType, left)

    return rows.select(*[named(F.col(f.name), f, depth).alias(f.name) for f in rows.schema.fields])


def _leaves(value, depth: int) -> Iterator[str]:
    if isinstance(value, str) and depth:
        yield value
    elif isinstance(value, list | dict) and depth:
        for inner in value.values() if isinstance(value, dict) else value:
            yield from _leaves(inner, depth - 1)


def string_leaves(json_text: Column, depth: int = 5) -> Column:
    """The strings of a JSON text in their order, those inside less than `depth` arrays and objects; none where the text is null or no JSON."""

    def read(text: str | None) -> list[str]:
        try:
            return list(_leaves(json.loads(text or "null"), depth))
        except (ValueError, RecursionError):
            return []

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(read)

    return F.pandas_udf(run, ArrayType(StringType()))(json_text)


def nested(fields: dict[str, Column]) -> Column:
    """A struct of columns under dotted names; where a name stands for a value and for a struct, the later one holds."""
    tree: dict[str, Column | dict] = {}
    for name, column in fields.items():
        *path, last = name.split(".")
        at = tree
        for step in path:
            if not isinstance(at.get(step), dict):
                at[step] = {}
            at = at[step]
        at[last] = column
    build = lambda t: F.struct(*[(build(v) if isinstance(v, dict) else v).alias(k) for k, v in t.items()])
    return build(tree)


def section_spans(text: Column, sections: Column) -> Column:
    """array<struct<heading, start, end>> of contiguous sections of a text, from an array of structs with heading and start.

    A section starts where its heading is found after the one named before it, else at its own start, cut to the text. In
    order of their starts, the first begins with the text, each ends where the next begins, the last with the text; empty
    ones go. Sections without a heading are left out; an empty or null text has none.
    """
    size = F.length(text)
    named = F.filter(sections, lambda s: s["heading"].isNotNull())

    def place(state: Column, s: Column) -> Column:
        title = F.trim(s["heading"])
        found = F.when(title != "", F.position(title, text, state["seen"] + 1) - 1)
        at = F.when(found >= 0, found).otherwise(F.greatest(F.least(F.coalesce(s["start"].cast("int"), F.lit(0)), size), F.lit(0)))
        row = F.struct(at.alias("at"), F.size(state["rows"]).alias("n"), s["heading"].cast("string").alias("heading"))
        return F.struct(F.greatest(state["seen"], at + 1).alias("seen"), F.concat(state["rows"], F.array(row)).alias("rows"))

    begin = F.struct(F.lit(0).alias("seen"), F.array().cast("array<struct<at: int, n: int, heading: string>>").alias("rows"))
    rows = F.array_sort(F.aggregate(named, begin, place, lambda state: state["rows"]))
    spans = F.transform(rows, lambda r, i: F.struct(r["heading"].alias("heading"), F.when(i == 0, 0).otherwise(r["at"]).alias("start"), F.coalesce(F.get(rows, i + 1)["at"], size).alias("end")))
    return F.when(size > 0, F.filter(spans, lambda s: s["end"] > s["start"])).otherwise(F.array().cast("array<struct<heading: string, start: int, end: int>>"))
