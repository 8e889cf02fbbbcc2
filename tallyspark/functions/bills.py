"""Keys of bills, what an analysis says of them, and dates in the names of archived files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dates import _safe

#: How dates stand in archive names: what the three groups of a pattern are.
FORMATS = {"MMDDYY": ("m", "d", "y"), "YYYY-MM-DD": ("y", "m", "d"), "MM/DD/YYYY": ("m", "d", "y")}


def external_id(session: Column, number: Column) -> Column:
    """The session's digits and the number without white space; a missing one counts as empty."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(F.regexp_replace(some(session), r"\D", ""), F.regexp_replace(some(number), r"\s", ""))


def measure_type(number: Column) -> Column:
    """The letters before a bill's number, in upper case; null where there are none."""
    return F.nullif(F.upper(F.trim(F.regexp_replace(number, r"(?s)\s*\d+.*$", ""))), F.lit(""))


def session_of(url: Column, otherwise: Column) -> Column:
    """The session a bill's address names, as two years one after the other at the beginning of its bill_id, else in the first eight digits in a row; otherwise a year and the next."""
    asked = F.regexp_extract(url, r"[?&]bill_id=([^&#]*)", 1)
    years = lambda c, head: (F.regexp_extract(c, rf"{head}(\d{{4}})(\d{{4}})", 1), F.regexp_extract(c, rf"{head}(\d{{4}})(\d{{4}})", 2))
    found = lambda y: F.when((y[0] != "") & (y[1].cast("int") == y[0].cast("int") + 1), F.concat_ws("-", *y))
    return F.coalesce(found(years(asked, "^")), found(years(url, "")), F.concat_ws("-", otherwise.cast("string"), (otherwise + 1).cast("string")))


def _strings(value: Column, path: str) -> Column:
    """The texts of an array in a variant, other values left out; null where there is no array."""
    items = F.try_variant_get(value, path, "array<variant>")
    return F.transform(F.filter(items, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.variant_get(x, "$", "string"))


def _text(value: Column, path: str) -> Column:
    inside = F.try_variant_get(value, path, "variant")
    return F.when(F.schema_of_variant(inside) == "STRING", F.variant_get(inside, "$", "string"))


def _object(json_text: Column) -> Column:
    """An analysis as a variant; null if it is no object, or says that it is to be skipped."""
    value = F.try_parse_json(json_text)
    flag = F.try_variant_get(value, "$.skip", "variant")
    skipped = F.coalesce((F.schema_of_variant(flag) == "BOOLEAN") & F.try_variant_get(flag, "$", "boolean"), F.lit(False))
    return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT<")) & ~skipped, value)


def rankable(json_text: Column) -> Column:
    """struct<topics, affects> of an analysis: texts only; null if it is no object, is to be skipped, or has neither."""
    value = _object(json_text)
    none = F.array().cast("array<string>")
    topics, affects = F.coalesce(_strings(value, "$.topics"), none), F.coalesce(_strings(value, "$.whoItAffects"), none)
    return F.when(value.isNotNull() & (F.size(topics) + F.size(affects) > 0), F.struct(topics.alias("topics"), affects.alias("affects")))


def summary(json_text: Column) -> Column:
    """An analysis as a struct, if it has all its parts in their kinds; else null."""
    value = _object(json_text)
    topics, affects = _strings(value, "$.topics"), _strings(value, "$.whoItAffects")
    plain, impact, level, fiscal = (_text(value, p) for p in ("$.plainEnglishSummary", "$.stakeholderImpact", "$.fiscalImpact.level", "$.fiscalImpact.summary"))
    whole = plain.isNotNull() & impact.isNotNull() & level.isNotNull() & fiscal.isNotNull() & topics.isNotNull() & affects.isNotNull()
    return F.when(whole, F.struct(plain.alias("summary"), topics.alias("topics"), affects.alias("affects"), F.struct(level.alias("level"), fiscal.alias("summary")).alias("fiscal"), impact.alias("impact")))


def archive_date(url: Column, anchor: Column, pattern: str, form: str = "MMDDYY") -> Column:
    """The date in an archived file's address, else in its link's text, by a pattern of three groups; two-digit years are of this century, dates that do not exist null."""
    if form not in FORMATS:
        return F.lit(None).cast("date")

    def of(c: Column) -> Column:
        g = {name: F.regexp_extract(c, pattern, k) for k, name in enumerate(FORMATS[form], 1)}
        year = F.concat(F.lit("20"), F.lpad(g["y"], 2, "0")) if form == "MMDDYY" else g["y"]
        return F.when((g["y"] != "") & (g["m"] != "") & (g["d"] != ""), _safe(year, g["m"], g["d"]))

    return F.when(url.rlike(pattern), of(url)).otherwise(of(anchor))


def json_rows(rows: DataFrame, column: str, fields: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each object of the JSON array in a column, its fields as the given types (null where they cannot be), with the kept columns beside them. What is no array has no rows."""
    items = F.try_variant_get(F.try_parse_json(column), "$", "array<variant>")
    one = rows.select(*keep, F.explode(items).alias("_item"))
    return one.select(*keep, *(F.try_variant_get("_item", f"$.{name}", kind).alias(name) for name, kind in fields.items()))
