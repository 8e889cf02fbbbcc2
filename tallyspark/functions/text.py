"""Text functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Legal forms and small words that say nothing of who a donor is.
DONOR_NOISE = ("pac", "inc", "llc", "corp", "co", "ltd", "committee", "the", "a", "of", "on", "and", "for")
# Personal data patterns in the order they are applied, with what replaces them.
REDACTIONS = (
    (r"\b(?:\d{4}[-.\s]?){3,4}\d{1,4}\b", "[REDACTED_CC]"),
    (r"\b\d{3}[-.\s]?\d{2}[-.\s]?\d{4}\b", "[REDACTED_SSN]"),
    (r"\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b", "$1***@$2"),
    (r"\b(?:\+?1[-.\s]?)?(?:\(?\d{3}\)?[-.\s]?)?\d{3}[-.\s]?(\d{4})\b", "***-***-$1"),
    (r"\b(\d{1,3})\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "$1.***.***.***"),
)


# The edge of a run of ASCII word characters, whatever letters stand beside it; and what is left of it before and after a digit.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
_BEFORE, _AFTER = r"(?=[0-9])(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def clean_cell(c: Column) -> Column:
    """A raw delimited cell: no NUL, trimmed, without one quote at either end."""
    return F.regexp_replace(F.trim(F.replace(c, F.lit("\0"), F.lit(""))), '^"|"$', "")


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_html(c: Column) -> Column:
    """Without tags; what follows an unclosed tag goes too."""
    return F.trim(F.regexp_replace(c, r"<[^>]*(>|$)", ""))


def body_text(html: Column) -> Column:
    """Visible text: scripts, styles, comments and tags dropped, white space collapsed."""
    plain = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b[^>]*>.*?</\1\s*>", " ")
    plain = F.regexp_replace(plain, r"(?s)<!--.*?-->", " ")
    return collapse(F.regexp_replace(plain, r"<[^>]*>", " "))


def readable_text(html: Column) -> Column:
    """Text of the main element, else of the article, else of the body, after boilerplate elements are dropped."""
    kept = F.regexp_replace(html, r"(?is)<(nav|header|footer|aside|form)\b[^>]*>.*?</\1\s*>", " ")
    inside = lambda tag: F.nullif(F.regexp_extract(kept, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1), F.lit(""))
    return body_text(F.coalesce(inside("main"), inside("article"), inside("body"), kept))


def links(html: Column, base: Column | None = None) -> Column:
    """Targets of anchors in order, quoted either way, without script, mail, phone and fragment ones; made absolute if a base is given."""
    found = F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*\bhref\s*=\s*['"]([^'"]+)['"]"""), F.lit(1))
    found = F.transform(found, lambda x: F.replace(F.regexp_replace(x, r"^\s+|\s+$", ""), F.lit("&amp;"), F.lit("&")))
    found = F.filter(found, lambda x: ~x.rlike(r"^(javascript:|mailto:|tel:|#)") & (x != ""))
    return found if base is None else F.transform(found, lambda x: resolve_url(base, x))


_SITE, _SCHEME = r"^(?i)(https?://[^/?#]*)", r"^[A-Za-z][A-Za-z0-9+.-]*:"


def _site(url: Column) -> Column:
    """Scheme and host in lower case, without the scheme's own port."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(url, _SITE, 1)), r"^(http://[^/]*):80$", "$1"), r"^(https://[^/]*):443$", "$1")


def _walked(path: Column) -> Column:
    """A path from the root with its . and .. steps taken."""
    last = F.element_at(F.split(path, "/", -1), -1)
    steps = F.slice(F.split(path, "/", -1), 2, 1 << 20)
    kept = F.aggregate(
        steps, F.array().cast("array<string>"), lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(x == ".", done).otherwise(F.concat(done, F.array(x)))
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def _whole(url: Column) -> Column:
    """An absolute http address with its path walked; others as they are."""
    rest = F.regexp_replace(url, _SITE, "")
    path, tail = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"^[^?#]*([\s\S]*)$", 1)
    return F.when(url.rlike(_SITE), F.concat(_site(url), _walked(F.when(path == "", "/").otherwise(path)), tail)).otherwise(url)


def resolve_url(base: Column, href: Column) -> Column:
    """The address a link leads to from a page: whole ones, ones without a scheme, paths from the root or the page's folder with . and .. steps, queries and fragments of the page itself."""
    page = F.regexp_replace(base, "#[\\s\\S]*$", "")
    bare = F.regexp_replace(page, r"\?[\s\S]*$", "")
    site = F.regexp_extract(bare, _SITE, 1)
    folder = F.regexp_replace(F.when(bare.rlike(r"^(?i)https?://[^/]*$"), F.concat(bare, F.lit("/"))).otherwise(bare), "[^/]*$", "")
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    found = (
        F.when(href.rlike(_SCHEME), href).when(href == "", page).when(href.startswith("#"), F.concat(page, href)).when(href.startswith("?"), F.concat(bare, href))
        .when(href.startswith("//"), F.concat(scheme, href)).when(href.startswith("/"), F.concat(site, href)).otherwise(F.concat(folder, href))
    )
    return F.when(base.isNull() | (base == ""), href).otherwise(_whole(found))


def canonical_url(url: Column) -> Column:
    """One form of a page's address: host in lower case, steps taken, no fragment and no slash at the end of a path; the query stays, as it may name another page. What is no http address stays as it is."""
    whole = _whole(F.regexp_replace(url, "#[\\s\\S]*$", ""))
    return F.when(url.rlike(_SITE), F.regexp_replace(whole, r"^(https?://[^/?]+/[^?]*[^/?]|https?://[^/?]+/[^?]*/)/(\?|$)", "$1$2")).otherwise(url)


def content_hash(c: Column) -> Column:
    return F.sha2(F.trim(F.regexp_replace(F.lower(c), r"\s+", " ")), 256)


def canonical_donor(name: Column) -> Column:
    """One key for spellings of a donor: words without punctuation and noise, sorted; the lowered name where none is left."""
    tokens = F.split(F.regexp_replace(F.replace(F.lower(name), F.lit("&"), F.lit(" and ")), r"[^a-z0-9\s]", " "), r"\s+")
    key = F.array_join(F.array_sort(F.filter(tokens, lambda t: (t != "") & ~t.isin(*DONOR_NOISE))), " ")
    return F.when(key == "", F.lower(name)).otherwise(key)


def normal_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "), r"\s+", " "))


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def quick_redactions() -> list[tuple[str, str, str]]:
    """The redactions as (pattern, what a text needs for it, replacement): word edges by looking beside a digit where one stands there, and tried only where a match may begin."""
    out = []
    for pattern, shown in REDACTIONS:
        body = pattern.removeprefix(r"\b").removesuffix(r"\b").replace(r"\d", "[0-9]")
        email = "@" in body
        first = _EDGE if email else f"(?=[+(0-9]){_EDGE}" if body.startswith(r"(?:\+") else _BEFORE
        out.append((first + body + (_EDGE if email else _AFTER), "@" if email else "[0-9]", shown if "$" in shown else shown.replace("[", r"\[").replace("]", r"\]")))
    return out


def redact(c: Column) -> Column:
    """Cards, social security numbers, e-mail (first letter and domain stay), phones (last four stay), addresses (first octet stays).

    Each pattern only meets texts that hold what it cannot do without: a digit, or an @.
    """
    for pattern, needed, shown in quick_redactions():
        c = F.when(F.contains(c, F.lit("@")) if needed == "@" else c.rlike(needed), F.regexp_replace(c, pattern, shown)).otherwise(c)
    return c


def partial_mask(c: Column, keep: int = 4) -> Column:
    """All but the last characters masked; short values wholly."""
    return F.when(F.length(c) <= keep, F.repeat(F.lit("*"), F.length(c))).otherwise(F.concat(F.repeat(F.lit("*"), F.length(c) - keep), F.right(c, F.lit(keep))))


def word_count(c: Column) -> Column:
    return F.when(F.trim(c) == "", 0).otherwise(F.size(F.split(F.trim(c), r"\s+")))


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive substring; wildcards of the needle are plain characters."""
    return F.contains(F.lower(c), F.lit(needle.lower()))


def name_order(c: Column) -> Column:
    """'Last, First' as 'First Last'; other names with single spaces."""
    parts = F.split(c, ",", 2)
    return F.when(F.contains(c, F.lit(",")), collapse(F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0])))).otherwise(collapse(c))


def device(agent: Column) -> Column:
    return F.when(agent.rlike("(?i)mobile"), "mobile").when(agent.rlike("(?i)tablet|ipad"), "tablet").when(agent.isNotNull() & (agent != ""), "desktop")


def browser(agent: Column) -> Column:
    has = lambda x: agent.rlike(f"(?i){x}")
    return F.when(has("chrome") & ~has("edge"), "Chrome").when(has("safari") & ~has("chrome"), "Safari").when(has("firefox"), "Firefox").when(has("edge"), "Edge")


def chunks(c: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Pieces of `size` characters that overlap; the last may be short. Null and empty texts have none."""
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - overlap - 1, F.lit(0)), F.lit(step))
    return F.when(F.length(c) > 0, F.transform(starts, lambda s: F.substr(c, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


# House, kind and number, with white space of any kind between them, as lines of a journal may break anywhere.
_CITED = r"(?i)(Assembly|Senate)\s{1,5}(Bill|Joint\s{1,5}Resolution|Concurrent\s{1,5}Resolution|Constitutional\s{1,5}Amendment)\s{1,5}(?:No\.\s{0,5})?(\d+)"


def citations(c: Column) -> Column:
    """Bill citations in canonical form, e.g. 'AB 12', in order: house and kind of measure shortened."""
    return F.transform(cited_spans(c), lambda x: x["bill"])


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it; an expression put into another by name is worked out at every place."""
    return F.element_at(F.transform(F.array(value), f), 1)  # get() would work out its own type, and so that of all within f, anew for each row


def cited_spans(c: Column) -> Column:
    """Bill citations as structs of bill, start and end: places in the text, code points from 0, the end exclusive."""
    kind = lambda t: F.concat(F.when(t.startswith("a"), "A").otherwise("S"), F.when(t.contains("bill"), "B").when(t.contains("joint"), "JR").when(t.contains("concurrent"), "CR").otherwise("CA"), F.lit(" "))
    bill = lambda x: F.concat(once(F.lower(x), kind), F.regexp_extract(x, r"\d+\z", 0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<bill: string, start: int, end: int>>").alias("spans"))

    def step(done: Column, x: Column) -> Column:
        def put(low: Column) -> Column:
            high = low + F.length(x)
            return F.struct(high.alias("at"), F.concat(done["spans"], F.array(F.struct(bill(x).alias("bill"), low.alias("start"), high.alias("end")))).alias("spans"))

        return once(F.position(x, c, done["at"] + 1) - 1, put)  # where its text next stands, as an earlier place would have been a citation

    return F.aggregate(F.regexp_extract_all(c, F.lit(_CITED), F.lit(0)), start, step, lambda done: done["spans"])


def safe_pattern(pattern: str, flags: str = "") -> str | None:
    """A pattern from outside with its leading flags gathered: i, m, s and u stay, others and groups that switch flags off are dropped. Null where nothing is left or it does not compile."""
    lead = re.match(r"(?:\(\?[A-Za-z-]+\))*", pattern)[0]
    groups = re.findall(r"[A-Za-z-]+", lead)
    asked = flags + "".join(g for g in groups if "-" not in g)
    kept, body = "".join(f for f in "imsu" if f in asked), pattern[len(lead) :]
    try:
        re.compile(body)
    except re.error:
        return None
    return (f"(?{kept})" if kept else "") + body if pattern else None


def safe_replace(c: Column, pattern: str, new: str, flags: str = "") -> Column:
    """All matches replaced; the text as it is where the pattern cannot be used."""
    fine = safe_pattern(pattern, flags)
    return c if fine is None else F.regexp_replace(c, fine, new)


def transformed(c: Column, kind: str, base: Column | None = None, pattern: str | None = None, replacement: str = "", flags: str = "") -> Column:
    """A value after a transform that a rule names: trim, lowercase, uppercase, strip_html, url_resolve, regex_replace, name_format or date_parse; any other name leaves it as it is."""
    from .dates import parse_date

    known = {
        "trim": lambda: F.regexp_replace(c, r"^\s+|\s+$", ""), "lowercase": lambda: F.lower(c), "uppercase": lambda: F.upper(c), "strip_html": lambda: strip_html(c), "url_resolve": lambda: c if base is None else F.when(c == "", c).otherwise(resolve_url(base, c)),
        "regex_replace": lambda: safe_replace(c, pattern, replacement, flags) if pattern else c, "name_format": lambda: name_order(c), "date_parse": lambda: F.coalesce(parse_date(c).cast("string"), F.trim(c)),
    }
    return known[kind]() if kind in known else c
