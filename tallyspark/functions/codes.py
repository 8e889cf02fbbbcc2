"""Code lists, identifiers and checks of short texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug

# Codes of the filings and what they stand for.
PARTIES = {"D": "Democratic", "DEMOCRAT": "Democratic", "DEMOCRATIC": "Democratic", "R": "Republican", "REPUBLICAN": "Republican", "I": "Independent", "INDEPENDENT": "Independent"}
SIDES = {"S": "support", "SUPPORT": "support", "O": "oppose", "OPPOSE": "oppose"}
DONORS = {"IND": "individual", "COM": "committee", "PTY": "party", "SCC": "individual", "OTH": "other"}
# Fewest and most words of an explanation, and phrases it must not hold.
MIN_WORDS, MAX_WORDS = 15, 30
OPINIONS = (
    r"\byou should\b", r"\bwe recommend\b", r"\bvote yes\b", r"\bvote no\b",
    r"\bvote for (this|the) (bill|measure|proposition)\b", r"\bvote against (this|the) (bill|measure|proposition)\b",
    r"\bsupport this (bill|measure|proposition)\b", r"\boppose this (bill|measure|proposition)\b",
    r"\bthis (bill|measure|proposition) is (good|bad|great|terrible)\b",
)
# Words that say what group a reader is of, and the flag by which the reader has said so.
PROTECTED = (
    (r"\bveteran(s)?\b", "isVeteran"), (r"\bimmigrant(s)?\b", "hasImmigrationConcern"), (r"\bundocumented\b", "hasImmigrationConcern"),
    (r"\bdisab(led|ility)\b", "hasHealthCondition"), (r"\bchronic( |ally) ill\b", "hasHealthCondition"),
    (r"\blow[- ]income\b", "isLowIncome"), (r"\bpoverty\b", "isLowIncome"), (r"\bformerly incarcerated\b", "hasJusticeInvolvement"),
    (r"\bmedicaid\b", "hasPublicHealthInsurance"), (r"\bmedi[- ]?cal\b", "hasPublicHealthInsurance"),
    (r"\bsnap (recipients?|beneficiaries|benefits?)\b", "receivesPublicBenefits"), (r"\bfood stamps?\b", "receivesPublicBenefits"),
    (r"\bpublic benefits?\b", "receivesPublicBenefits"), (r"\bwelfare recipients?\b", "receivesPublicBenefits"), (r"\b(tanf|calworks)\b", "receivesPublicBenefits"),
)
_DATE, _ISO = r"\d{1,2}/\d{1,2}/\d{2,4}", r"\d{4}-\d{2}-\d{2}"


def _mapped(key: Column, values: dict[str, str], otherwise: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), otherwise)


def party(c: Column) -> Column:
    """The party of a code or name, in brackets or not; an unknown one stays, a missing one is Unknown."""
    return F.when(F.coalesce(c, F.lit("")) == "", "Unknown").otherwise(_mapped(F.trim(F.regexp_replace(F.upper(c), "[()]", "")), PARTIES, c))


def side(c: Column, default: str | None = None) -> Column:
    return _mapped(F.upper(c), SIDES, F.lit(default).cast("string"))


def donor_type(c: Column) -> Column:
    return _mapped(F.upper(c), DONORS, F.lit("other"))


def representative_id(raw: Column, chamber: Column) -> Column:
    """ca-chamber-district with the last number of the raw id; one without a number stays as it is."""
    digits = F.try_element_at(F.regexp_extract_all(raw, F.lit(r"\d+"), F.lit(0)), F.lit(-1))
    made = F.concat(F.lit("ca-"), F.lower(F.trim(F.coalesce(chamber, F.lit("unknown")))), F.lit("-"), digits)
    return F.when(raw.rlike(r"(?i)^ca-(assembly|senate)-\d+$"), F.lower(raw)).otherwise(F.coalesce(made, raw))


def bare_date(c: Column) -> Column:
    return c.rlike(f"^({_DATE}|{_ISO})$")


def composite_id(c: Column) -> Column:
    """An id that holds a date, or has two parts at least."""
    parts = F.size(F.filter(F.split(c, "[-_]"), lambda x: x != ""))
    return c.rlike(f"{_DATE}|{_ISO}") | (parts >= 2)


def meeting_id(raw: Column, title: Column, scheduled: Column, body: Column) -> Column:
    """The raw id if it tells meetings apart, else body, title and date joined; null if one of them is missing."""
    trusted = F.coalesce(composite_id(raw) & ~bare_date(raw) & (raw != ""), F.lit(False))
    given = lambda c: F.nullif(c, F.lit(""))
    date = F.when(F.coalesce(bare_date(raw), F.lit(False)), raw).otherwise(given(scheduled))
    return F.when(trusted, raw).otherwise(F.concat(given(slug(body)), F.lit("-"), given(slug(F.substring(title, 1, 50))), F.lit("-"), date))


def clean_title(c: Column) -> Column:
    """A measure's title without its number and author before it, groups in brackets after it (nested once at most), and the last full stop."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Z]+\s*\d+\s*\([^)]*\)\s*", "")
    bare = F.regexp_replace(bare, r"(?:\s*\((?:[^()]|\([^()]*\))*\))+\s*$", "")
    bare = F.trim(F.regexp_replace(bare, r"\.$", ""))
    return F.when(bare == "", F.trim(c)).otherwise(bare)


def explanation_fault(text: Column, flags: Column) -> Column:
    """Why an explanation is not shown: empty, word-count, opinion-language or protected-class-leak; null if it may be."""
    said = F.trim(F.coalesce(text, F.lit("")))
    n = F.size(F.split(said, r"\s+"))
    opinion = said.rlike("(?i)" + "|".join(OPINIONS))
    leak = F.lit(False)
    for pattern, flag in PROTECTED:
        leak = leak | (said.rlike(f"(?i){pattern}") & ~F.coalesce(F.array_contains(flags, flag), F.lit(False)))
    return F.when(said == "", "empty").when((n < MIN_WORDS) | (n > MAX_WORDS), "word-count").when(opinion, "opinion-language").when(leak, "protected-class-leak")


def passage(text: Column, start: Column, end: Column, most: int = 1024, around: int = 500) -> Column:
    """struct<passage, context>: a passage of at most `most` characters, and with so many around it, widened to white space within 50."""
    low = F.greatest(start, F.lit(0))
    high = F.least(end, low + most, F.length(text))
    begin, stop = F.greatest(low - around, F.lit(0)), F.least(high + around, F.length(text))
    before = F.length(F.regexp_extract(F.substr(text, F.greatest(begin - 50, F.lit(0)) + 1, F.least(begin, F.lit(50))), r"(\S*)$", 1))
    after = F.length(F.regexp_extract(F.substr(text, stop + 1, F.lit(50)), r"^(\S*)", 1))
    cut = lambda a, b: F.substr(text, a + 1, b - a)
    return F.struct(cut(low, high).alias("passage"), cut(begin - before, stop + after).alias("context"))


def session_key(url: Column, pattern: Column, discriminator: Column) -> Column:
    """Source, file pattern if there is one, and what tells sources of one address apart, joined by #."""
    return F.concat_ws("#", url, F.nullif(pattern, F.lit("")), discriminator)


def source_system(category: Column) -> Column:
    low = F.lower(category)
    return F.when(F.contains(low, F.lit("cal-access")) | F.contains(low, F.lit("cal_access")), "cal_access").when(F.contains(low, F.lit("fec")), "fec")


def valid_bio(c: Column, noise: tuple[str, ...] = (r"^Home\b", "Latest News")) -> Column:
    """At least 100 characters and none of the patterns of page furniture."""
    bare = F.trim(c)
    out = F.length(bare) >= 100
    for pattern in noise:
        out = out & ~bare.rlike(f"(?i){pattern}")
    return F.coalesce(out, F.lit(False))


def donor_name(whole: Column, last: Column, first: Column) -> Column:
    """The name as given, else 'Last, First' from its parts, else the part there is."""
    given = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(given(whole), F.nullif(F.concat_ws(", ", given(last), given(first)), F.lit("")))


def rules_confidence(fields: Column, has_required: Column, selectors: Column, notes: Column) -> Column:
    """How far extraction rules may be trusted: 0.5, and 0.1 each for 3 and for 5 fields, a required one, a class in a selector, notes of over 20 characters; 1 at most."""
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    steps = yes(fields >= 3) + yes(fields >= 5) + yes(has_required) + yes(F.contains(selectors, F.lit("."))) + yes(F.length(notes) > 20)
    return F.least((steps + 5) / 10, F.lit(1.0))
