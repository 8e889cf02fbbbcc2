"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card (Luhn) and phone. The method adds iban (mod-97), ssn and secret (a value named as a key or
token). Every span gets a score from its kind's own evidence plus what words stand near it; base spans always stay, added
kinds only from MIN_SCORE on. Each scan is linear in the text: patterns start only where their first run starts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ._tables import enter, id_text, small_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "secret")
#: Characters looked at on each side of a span for context words, and the score below which an added span is dropped.
WINDOW, MIN_SCORE = 40, 0.5

# The patterns of the base kinds, each anchored where its leading run begins, so that a failing run is read once.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# The added kinds.
IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?i)(?<![a-z0-9])(?:api_?key|secret|token|passw(?:or)?d|access_?key)\x20?[:=]\x20?[\"']?([A-Za-z0-9_./+=-]{12,})")
# How many characters an account number has in each country.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: Words that raise or lower the score of a kind, as whole words in lower case.
CONTEXT = {
    "email": (("mail", "email", "contact", "write"), ("example", "noreply")),
    "ip": (("ip", "host", "server", "address"), ("version", "release", "build")),
    "card": (("card", "visa", "credit", "debit", "karte", "carte", "tarjeta"), ("order", "isbn", "serial")),
    "phone": (("phone", "tel", "call", "mobile", "fax"), ("version", "id")),
    "iban": (("iban", "account", "konto", "compte", "cuenta", "bank"), ("serial",)),
    "ssn": (("ssn", "social", "security"), ("part", "model", "serial")),
    "secret": (("key", "secret", "token", "password", "credential"), ("test", "dummy")),
}
#: A span's score before its context: an address or checked number says more than digits of a certain shape.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.5, "secret": 0.6}
_WORD = re.compile(r"[a-z]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain, found from each @ outwards."""
    done, at = 0, text.find("@")
    while at >= 0:
        low = at
        if at > done and (m := DOMAIN.match(text, at + 1)):
            step = 64
            while True:  # the run before @, read backwards in growing slices
                begin = max(done, at - step)
                tail = LOCAL_TAIL.search(text[begin:at])
                low = begin + tail.start() if tail else at
                if low > begin or begin == done:
                    break
                step *= 4
            if low < at:
                yield low, m.end()
                done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        if all(len(p) <= 3 or not p.lstrip("0")[3:] for p in m[0].split(".")) and all(int(p[-4:]) <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 8 <= sum(map(str.isdigit, m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Numbers cut to their country's length; what follows may be any word after a space."""
    at = 0
    while m := IBAN.search(text, at):
        at = m.end(1)
        want = IBAN_SIZES.get(m[1])
        places = [k for k in range(*m.span()) if text[k] != " "]
        if want and len(places) >= want:
            end = places[want - 1] + 1
            if not text[end : end + 1].isalnum() and mod97(text[m.start() : end]):
                yield m.start(), end
                at = end


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    for m in SECRET.finditer(text):
        yield m.span(1)


FINDERS: dict[str, Callable[[str], Iterator[tuple[int, int]]]] = {
    "email": emails, "ip": _ips, "card": _cards, "phone": _phones,
    "iban": _ibans, "ssn": lambda t: (m.span() for m in SSN.finditer(t)), "secret": _secrets,
}
_DIGIT = re.compile("[0-9]")


def score(kind: str, text: str, start: int, end: int) -> float:
    """The kind's prior, 0.2 more for a supporting word nearby, 0.3 less for a word that speaks against it; from 0 to 1."""
    near = set(_WORD.findall(text[max(0, start - WINDOW) : start].lower())) | set(_WORD.findall(text[end : end + WINDOW].lower()))
    more, less = CONTEXT[kind]
    return min(1.0, max(0.0, PRIOR[kind] + 0.2 * (not near.isdisjoint(more)) - 0.3 * (not near.isdisjoint(less))))


def find_spans(text: str, min_score: float = MIN_SCORE) -> list[tuple[str, int, int, float]]:
    """All spans by kind as listed in KINDS, then start: kind, first code point, the one after the last, score."""
    digits = _DIGIT.search(text) is not None
    out = []
    for kind in KINDS:
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text or kind not in ("email", "secret") and not digits:
            continue
        for start, end in FINDERS[kind](text):
            sure = score(kind, text, start, end)
            if kind in BASE_KINDS or sure >= min_score:
                out.append((kind, start, end, sure))
    return out


def redact(text: str, spans: list[tuple[str, int, int, float]], min_score: float = MIN_SCORE, base: bool = False) -> str:
    """The text with every span at or above min_score, and with base every confirmed span of a base kind, replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, done = [], 0
    for start, end, kind in sorted((s, -e, k) for k, s, e, sure in spans if sure >= min_score or base and k in BASE_KINDS):
        end = -end
        if start >= done:
            out += [text[done:start], f"[{kind.upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", redacted: bool = True, min_score: float = MIN_SCORE) -> DataFrame:
    """For each row: doc_id, spans array<struct<kind, start, end, score>> and, if redacted, the text with its spans masked.

    Narrow: no shuffle; a row is read once and whole. Redaction masks what scores min_score at least, so that a base span that
    its context speaks against (an ip after "version") is reported and stays in the text. Null text: empty, no spans. Null ids stay null, repeated rows give
    repeated results, an empty table gives none; other columns are not read. Overlaps between kinds are all reported.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = [find_spans(t, min_score) for t in texts]
            out = {"doc_id": batch.column(0), "spans": pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in x] for x in found], kind)}
            if redacted:
                out["redacted"] = pa.array([redact(t, x, min_score) if x else t for t, x in zip(texts, found)], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind: string, start: bigint, end: bigint, score: double>>{', redacted string' if redacted else ''}")


def redact_documents(docs: DataFrame, columns: tuple[str, ...], text_col: str = "text", min_score: float = MIN_SCORE, base: bool = False) -> DataFrame:
    """The given columns of docs with text_col redacted; a null text stays null. Narrow, as detect(). base: also what its context speaks against, if it is of a base kind and confirmed."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("pii")
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            done = [t if t is None or not (s := find_spans(t, min_score)) else redact(t, s, min_score, base) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(done, batch.schema.field(at).type))

    rows = docs.select(*columns)
    return rows.mapInArrow(run, rows.schema)

