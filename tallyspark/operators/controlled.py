"""Candidates' own committees and the representatives they belong to, with links withdrawn when a committee's name no longer bears them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import SURNAME, given_names_match, soften
from ..functions.text import alnum_key

# What says in a committee's name that it is not the candidate's own; words of such names that are no given names; titles and suffixes of people;
# given names that stand for each other; office codes; the source whose committees are linked, and the region whose representatives are not.
MARKERS = ("in support of", "in opposition to", "opposed to", "opposing", "supporting", "sponsored by", "ballot measure", "independent expenditure", "recall")
NO_GIVEN = (
    "for", "of", "the", "to", "and", "a", "an", "friends", "committee", "elect", "reelect", "re", "citizens", "californians", "people", "voters", "taxpayers", "neighbors", "speaker", "senator",
    "assemblymember", "assemblyman", "assemblywoman", "councilmember", "supervisor", "mayor", "dr", "hon",
)
TITLES = ("dr", "mr", "mrs", "ms", "rev", "hon", "sen", "asm", "prof")
SUFFIXES = ("jr", "sr", "ii", "iii", "iv", "v")
NICKNAMES = (
    ("thomas", "tom", "tommy"), ("stephen", "steven", "steve"), ("michael", "mike"), ("robert", "rob", "bob", "bobby"), ("william", "will", "bill", "billy"), ("james", "jim", "jimmy"), ("joseph", "joe", "joey"),
    ("richard", "rick", "dick"), ("charles", "charlie", "chuck"), ("john", "jack", "johnny"), ("edward", "ed", "eddie"), ("margaret", "maggie", "peggy"), ("elizabeth", "liz", "beth"), ("katherine", "kathryn", "kate", "kathy"),
    ("patricia", "patty", "trish"), ("susan", "sue"), ("lawrence", "larry"), ("anthony", "tony"), ("francisco", "paco"), ("manuel", "manny"),
)
OFFICES = {"ASM": "Assembly", "ASSEMBLY": "Assembly", "SEN": "Senate", "SENATE": "Senate"}
SOURCE, ELSEWHERE = "cal_access", "federal"
_GROUP = {name: group[0] for group in NICKNAMES for name in group}


def _words(c: Column) -> Column:
    return F.filter(F.split(soften(c), " "), lambda w: w != "")


def surname(candidate: Column) -> Column:
    """What stands before a comma, else the last word that is no suffix, else the whole."""
    plain = F.trim(candidate)
    kept = F.filter(F.split(plain, r"\s+"), lambda w: ~F.regexp_replace(F.lower(w), "[^a-z]", "").isin(*SUFFIXES))
    return F.when(F.contains(plain, F.lit(",")), F.trim(F.split(plain, ",")[0])).otherwise(F.coalesce(F.try_element_at(kept, F.lit(-1)), plain))


def given_name(full: Column) -> Column:
    """A person's first word that is no title; empty where there is none."""
    return F.coalesce(F.get(F.filter(_words(full), lambda w: ~w.isin(*TITLES)), F.lit(0)), F.lit(""))


def seat(office: Column, name: Column) -> Column:
    """The chamber by the code of the office, else by the committee's name."""
    code = F.upper(F.trim(office))
    by_code = F.coalesce(*(F.when(code == k, v) for k, v in OFFICES.items()))
    return F.coalesce(by_code, F.when(F.contains(soften(name), F.lit("assembly")), "Assembly").when(F.contains(soften(name), F.lit("senate")), "Senate"))


def _given_in(name: Column, last: Column) -> Column:
    """Words of a committee's name that may be given names: those before the surname's last word, and those behind a semicolon."""
    own = _words(last)
    keep = lambda words: F.filter(words, lambda w: ~w.isin(*NO_GIVEN) & ~F.array_contains(own, w) & ~w.rlike(r"^\d+$"))
    parts = F.split(name, ";", -1)
    head = _words(parts[0])
    at = F.array_position(head, F.try_element_at(own, F.lit(-1)))
    before = F.when(at > 1, F.slice(head, F.lit(1), F.greatest(at.cast("int") - 1, F.lit(0)))).otherwise(F.slice(head, 1, 0))
    return F.when(F.size(own) > 0, F.concat(keep(before), keep(_words(F.array_join(F.slice(parts, 2, 1 << 20), " "))))).otherwise(F.slice(head, 1, 0))


def is_own(name: Column, last: Column, given: Column) -> Column:
    """Whether a committee's name lets it be a candidate's own: no marker of another kind, the surname in it (if that has SURNAME letters), and no other given name."""
    soft, key = soften(name), alnum_key(F.coalesce(last, F.lit("")))
    marked = F.exists(F.array(*map(F.lit, MARKERS)), lambda m: F.contains(soft, m))
    named = _given_in(name, F.coalesce(last, F.lit("")))
    agrees = (F.coalesce(given, F.lit("")) == "") | (F.size(named) == 0) | F.exists(named, lambda g: given_names_match(g, F.coalesce(given, F.lit("")), _GROUP))
    return F.coalesce(~marked & ((F.length(key) < SURNAME) | (F.contains(alnum_key(name), key) & agrees)), F.lit(False))


def resolved(committees: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, found, outcome): the representative each committee is about: linked, ambiguous, unmatched or not_controlled.

    By the candidate's surname in the chamber, if there is a candidate; else by the one representative of the chamber whose surname stands in the committee's
    name. Surnames are joined by chamber and, for the latter, by their first SURNAME letters wherever these stand in the name. Representatives of one surname and
    chamber are gathered before: a committee needs the least of them, and whether there is another.
    """
    here = reps.where(F.col("deleted_at").isNull() & ~F.coalesce(F.col("region") == ELSEWHERE, F.lit(False)) & F.col("chamber").isNotNull())
    last = F.when(F.coalesce("last_name", F.lit("")) != "", F.col("last_name")).otherwise(F.element_at(F.split(F.trim("name"), r"\s+"), -1))
    known = here.select("rep_id", last.alias("last"), alnum_key(last).alias("key"), F.lower(F.trim("chamber")).alias("body"), given_name(F.col("name")).alias("given")).where("key <> ''")
    known = known.groupBy("key", "body").agg(F.min(F.struct("rep_id", "given")).alias("by_given"), F.min(F.struct("rep_id", "last", "given")).alias("by_last"), F.max("rep_id").alias("most"))
    asked = committees.select("id", "name", "candidate_name", F.lower(seat(F.col("candidate_office"), F.col("name"))).alias("body"))
    has = F.coalesce("candidate_name", F.lit("")) != ""
    by_last = asked.where(has).withColumn("key", alnum_key(surname(F.col("candidate_name")))).join(known, ["key", "body"])
    by_last = by_last.select("id", "most", F.struct("by_given.rep_id", surname(F.col("candidate_name")).alias("last"), "by_given.given", "name").alias("h"))
    own = alnum_key(F.col("name"))
    starts = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(own) - SURNAME + 1, F.lit(1))), lambda k: F.substr(own, k, F.lit(SURNAME))))
    in_name = asked.where(~has).withColumn("start", F.explode(starts)).join(known.where(F.length("key") >= SURNAME).withColumn("start", F.left("key", F.lit(SURNAME))), ["start", "body"]).where(F.contains(own, F.col("key")))
    hits = by_last.unionByName(in_name.select("id", "most", F.struct("by_last.rep_id", "by_last.last", "by_last.given", "name").alias("h")))
    one = hits.groupBy("id").agg(F.max("most").alias("most"), F.min("h").alias("h"))
    fine = is_own(F.col("h.name"), F.col("h.last"), F.col("h.given"))
    outcome = F.when(F.col("h").isNull(), "unmatched").when(F.col("most") > F.col("h.rep_id"), "ambiguous").when(fine, "linked").otherwise("not_controlled")
    return committees.select("id").join(one, "id", "left").select("id", F.when(outcome == "linked", F.col("h.rep_id")).alias("found"), outcome.alias("outcome"))


def relinked(committees: DataFrame, reps: DataFrame) -> DataFrame:
    """(id, rep_id, action) of the committees of SOURCE that are not deleted, as they should be: a stored link stays while the committee's name bears it out, else it is withdrawn; what has none is looked up.

    committees: id, name, candidate_name, candidate_office, rep_id, source_system, deleted_at; reps: rep_id, name, last_name, chamber, region, deleted_at. action: kept, linked, moved (withdrawn and
    linked to another), withdrawn, or why there is no link: ambiguous, unmatched, not_controlled. Run again on its result it changes nothing.
    """
    rows = committees.where((F.col("source_system") == SOURCE) & F.col("deleted_at").isNull())
    of_rep = reps.select(F.col("rep_id").alias("own_id"), F.col("name").alias("own_name"), F.col("last_name").alias("own_last"))
    held = rows.join(of_rep, F.col("rep_id") == F.col("own_id"), "left")
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    last = F.coalesce(some(surname(F.col("candidate_name"))), some(F.col("own_last")), F.element_at(F.split(F.trim("own_name"), r"\s+"), -1))
    stays = F.col("rep_id").isNotNull() & is_own(F.col("name"), last, given_name(F.col("own_name")))
    held = held.select("id", "rep_id", stays.alias("stays"))
    out = held.join(resolved(rows, reps), "id")
    action = F.when(F.col("stays"), "kept").when(F.col("rep_id").isNotNull() & F.col("found").isNull(), "withdrawn").when(F.col("rep_id").isNotNull(), F.when(F.col("found") == F.col("rep_id"), "kept").otherwise("moved")).otherwise(F.col("outcome"))
    return out.select("id", F.when(F.col("stays"), F.col("rep_id")).otherwise(F.col("found")).alias("rep_id"), action.alias("action"))
