"""Entity linking: exact and prefix titles, unique names, surnames in titles."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.names import SURNAME, committee_key, given_names_match
from ..functions.text import alnum_key, normal_title
from .merge import first_by, free


def unique_match(left: DataFrame, right: DataFrame, on: list[str], id_col: str) -> DataFrame:
    """Adds id_col where exactly one id of right has the keys; ambiguous keys link to none."""
    n = free("_n", right)
    one = right.groupBy(*on).agg(F.min(id_col).alias(id_col), F.countDistinct(id_col).alias(n)).where(F.col(n) == 1).drop(n)
    return left.join(one, on, "left")


def exact_then_unique(left: DataFrame, right: DataFrame, name: str, id_col: str) -> DataFrame:
    """By exact name (of several the least id), else by the normalised name if only one id has it."""
    exact, near, a, b, n = (free(x, left, right) for x in ("_exact", "_key", "_a", "_b", "_n"))
    whole = right.groupBy(F.col(name).alias(exact)).agg(F.min(id_col).alias(a))
    keyed = right.withColumn(near, committee_key(F.col(name))).where(F.col(near) != "")
    one = keyed.groupBy(near).agg(F.min(id_col).alias(b), F.countDistinct(id_col).alias(n)).where(F.col(n) == 1).drop(n)
    out = left.withColumn(exact, F.col(name)).withColumn(near, committee_key(F.col(name))).join(whole, exact, "left").join(one, near, "left")
    return out.withColumn(id_col, F.coalesce(a, b)).drop(exact, near, a, b)


def link_titles(left: DataFrame, right: DataFrame, title: str, id_col: str, seq: str) -> DataFrame:
    """By normalised title (of equal ones the last by seq), else the first title by seq that begins with the first two words.

    The prefix is an equi-join: each title offers its own first two words as a key, so no pair is compared that cannot
    match. Words of one letter do not count, and a title needs two.
    """
    t, p, two, exact, near, at = (free(x, left, right) for x in ("_t", "_p", "_two", "_exact", "_near", "_seq"))
    probe = lambda c: F.slice(F.filter(F.split(c, " "), lambda x: F.length(x) > 1), 1, 2)
    keyed = right.withColumn(t, normal_title(F.col(title)))
    titles = keyed.groupBy(t).agg(F.max_by(id_col, seq).alias(exact), F.min(seq).alias(at))
    words = F.split(F.col(t), " ")
    starts = titles.withColumn(p, F.array_join(F.slice(words, 1, 2), " ")).where(F.size(words) >= 2).groupBy(p).agg(F.min_by(exact, at).alias(near))
    rows = left.withColumn(t, normal_title(F.col(title))).withColumn(two, probe(F.col(t)))
    rows = rows.withColumn(p, F.when(F.size(two) == 2, F.array_join(two, " ")))
    out = rows.join(titles.select(t, exact), t, "left").join(starts, p, "left")
    return out.withColumn(id_col, F.coalesce(exact, near)).drop(t, two, p, exact, near)


def link_candidates(committees: DataFrame, reps: DataFrame, name: str = "name", rep_id: str = "rep_id", surname: str = "last_name", given: str = "first_name", chamber: str = "chamber") -> DataFrame:
    """Committees whose title holds the surname of just one representative of the chamber, and no other given name before it.

    A surname in a title is a word of it, so titles are exploded to words and joined by (chamber, surname key).
    """
    words = committees.withColumn("_w", F.explode(F.array_distinct(F.split(normal_title(F.col(name)), " "))))
    keyed = reps.select(chamber, F.col(rep_id), F.col(given).alias("_given"), alnum_key(F.col(surname)).alias("_w")).where(F.length("_w") >= SURNAME)
    before = F.split(normal_title(F.col(name)), " ")
    found = words.join(keyed, [chamber, "_w"]).withColumn("_at", F.array_position(before, F.col("_w"))).withColumn("_before", F.slice(before, 1, F.greatest(F.col("_at") - 1, F.lit(0)).cast("int")))
    plain = ("friends", "of", "committee", "to", "elect", "re", "for", "the", "dr", "mr", "ms", "mrs", "senator", "assemblymember")
    named = F.filter("_before", lambda t: ~t.isin(*plain) & ~t.rlike(r"^\d+$"))
    agrees = (F.size(named) == 0) | F.exists(named, lambda t: given_names_match(t, F.col("_given")))
    one = found.where(agrees).groupBy("id").agg(F.min(rep_id).alias(rep_id), F.countDistinct(rep_id).alias("_n")).where("_n = 1").drop("_n")
    return committees.join(one, "id", "left")


#: Names in one automaton.
NAMES = 100_000


def _hits(left: DataFrame, needles: DataFrame, text: str, needle: str, needle_id: str, left_id: str, every: bool, most: int) -> DataFrame:
    """(left_id, found): ids of needles in each text, all of them or the least of an automaton. The needles are dealt to automata of about `most` names, each of which reads the texts once."""
    kind = needles.schema[needle_id].dataType
    known = needles.where((F.col(needle) != "") & F.col(needle_id).isNotNull()).groupBy(F.lower(needle).alias("name")).agg((F.collect_set(needle_id) if every else F.array(F.min(needle_id))).alias("ids"))
    parts = max(1, -(-known.count() // most))
    out = None
    for part in range(parts):
        mine = known if parts == 1 else known.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part)
        names = [(r["name"], sorted(r["ids"])) for r in mine.collect()]

        def run(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for name, own in names:
                machine.add_word(name, own)
            if names:
                machine.make_automaton()
            for batch in batches:
                found = [{i for _, own in machine.iter(t.lower()) for i in own} if t and names else () for t in batch.column(1).to_pylist()]
                found = [sorted(f) if every else [min(f)] if f else [] for f in found]
                rows = np.repeat(np.arange(len(found)), list(map(len, found)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array([i for f in found for i in f], to_arrow_type(kind))], names=["id", "found"])

        one = left.select(left_id, text).mapInArrow(run, f"id {left.schema[left_id].dataType.simpleString()}, found {kind.simpleString()}")
        out = one if out is None else out.unionByName(one)
    return out


def first_containing(left: DataFrame, needles: DataFrame, text: str, needle: str, needle_id: str, left_id: str, most: int = NAMES) -> DataFrame:
    """The least needle id found in each text, case-insensitively; texts without any are left out, and of rows of one left id the least counts. Any number of needles: see _hits()."""
    hit = _hits(left, needles, text, needle, needle_id, left_id, False, most)
    return hit.groupBy(F.col("id").alias(left_id)).agg(F.min("found").alias(needle_id))


def all_containing(left: DataFrame, needles: DataFrame, text: str, needle: str, needle_id: str, left_id: str, most: int = NAMES) -> DataFrame:
    """(left_id, needle_id): every needle found in each text, case-insensitively, once for each id."""
    return _hits(left, needles, text, needle, needle_id, left_id, True, most).distinct().toDF(left_id, needle_id)


def links_after(stored: DataFrame, found: DataFrame, read: DataFrame, left_id: str, needle_id: str) -> DataFrame:
    """Links of texts to names once some texts (left_id) have been read again: what people made stays, what was found before and is not any more goes, and what is found is added where there is no link.

    stored: left_id, needle_id, source (`manual` or `auto`).
    """
    again = stored.where("source <> 'manual'").join(read.select(left_id).distinct(), left_id, "left_semi")
    keys = [left_id, needle_id]
    gone = again.join(found, keys, "left_anti").select(*keys)
    kept = stored.join(gone.withColumn("source", F.lit("auto")), [*keys, "source"], "left_anti").select(*keys, "source")
    new = found.join(kept, keys, "left_anti").select(*keys, F.lit("auto").alias("source"))
    return kept.unionByName(new)


def existing_elsewhere(rows: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys, nulls equal to nulls, no stored row has; of rows of equal keys the first by all columns."""
    own = {k: free(f"_{k}", rows) for k in keys}
    known = stored.select(*[F.col(k).alias(own[k]) for k in keys]).distinct()
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(own[k]))
    return first_by(rows.join(known, cond, "left_anti"), keys, *[F.asc_nulls_first(c) for c in rows.columns])


def first_key_that_links(left: DataFrame, titles: DataFrame, keys: list[str], title: str, id_col: str) -> DataFrame:
    """Adds id_col by the first of some keys (a ballot number, then a name) that is a title, both normalised; of equal titles the greatest id."""
    table = titles.groupBy(normal_title(F.col(title)).alias("title_key")).agg(F.max(id_col).alias("title_id")).where("title_key <> ''")
    out, found = left, []
    for n, key in enumerate(keys):
        mine = table.withColumnsRenamed({"title_key": f"title_key_{n}", "title_id": f"title_id_{n}"})
        out = out.withColumn(f"title_key_{n}", normal_title(F.col(key))).join(mine, f"title_key_{n}", "left").drop(f"title_key_{n}")
        found.append(f"title_id_{n}")
    return out.withColumn(id_col, F.coalesce(*found)).drop(*found)


def by_surname(rows: DataFrame, reps: DataFrame, name: str, chamber: str, rep_id: str, last_name_col: str) -> DataFrame:
    """Adds rep_id where just one representative of the chamber has the row's whole name as surname, else its last word; else null."""
    keyed = reps.groupBy(F.col(chamber).alias("name_chamber"), alnum_key(F.col(last_name_col)).alias("name_key")).agg(F.min(rep_id).alias("name_id"), F.countDistinct(rep_id).alias("n")).where("n = 1 AND name_key <> ''").drop("n")
    out = rows
    for n, key in enumerate((alnum_key(F.col(name)), alnum_key(F.element_at(F.split(F.trim(name), r"\s+"), -1)))):
        mine = keyed.withColumnsRenamed({"name_chamber": f"name_chamber_{n}", "name_key": f"name_key_{n}", "name_id": f"name_id_{n}"})
        out = out.withColumn(f"name_key_{n}", key).withColumn(f"name_chamber_{n}", F.col(chamber)).join(mine, [f"name_key_{n}", f"name_chamber_{n}"], "left").drop(f"name_key_{n}", f"name_chamber_{n}")
    return out.withColumn(rep_id, F.coalesce("name_id_0", "name_id_1")).drop("name_id_0", "name_id_1")


def name_index(reps: DataFrame, name: str, rep_id: str, seq: str) -> DataFrame:
    """(key, rep_id): whole names in lower case, of equal ones the last by seq; and last words of names that are no whole name, of equal ones the first."""
    low = F.lower(F.trim(name))
    whole = reps.groupBy(low.alias("key")).agg(F.max_by(rep_id, seq).alias(rep_id))
    last = reps.groupBy(F.element_at(F.split(low, r"\s+"), -1).alias("key")).agg(F.min_by(rep_id, seq).alias(rep_id)).join(whole, "key", "left_anti")
    return whole.unionByName(last).where("key <> ''")


def by_name_index(rows: DataFrame, index: DataFrame, name: str, rep_id: str) -> DataFrame:
    """Adds rep_id by a name_index(): the whole name, else its last word; null where neither is in it."""
    whole, last, a, b = (free(x, rows, index) for x in ("_whole", "_last", "_a", "_b"))
    low = F.lower(F.trim(F.regexp_replace(name, r"\s+", " ")))
    out = rows.withColumn(whole, low).withColumn(last, F.element_at(F.split(low, " "), -1))
    for key, found in ((whole, a), (last, b)):
        out = out.join(index.select(F.col("key").alias(key), F.col(rep_id).alias(found)), key, "left")
    return out.withColumn(rep_id, F.coalesce(a, b)).drop(whole, last, a, b)
