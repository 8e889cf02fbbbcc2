"""Chat formatting of typed content parts, in DataFrame functions only.

A message is a list of parts: text, image, audio or document. A visitor turns each part in its order into text: text is
escaped, an attachment becomes its placeholder; references, places and token counts of the attachments are recorded. Turns
are set between markers. Inside texts and roles, a control string gets a backslash after its first character (one more if it
has some already), so that no control string of the output stems from a text, and dropping one backslash gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The template's markers, placeholders, and further control strings of common chat formats.
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
_TAILS = r"\\*(?:\|(?:im_start|im_end|image|audio|document)\|>|/?s>|</?SYS>>|/?INST\])"
_ESCAPE, _UNESCAPE = rf"([<\[])({_TAILS})", rf"([<\[])\\({_TAILS})"
#: Tokens that one attachment stands for: of an image by patches of 14 pixels, of audio by seconds, of a document by pages.
PATCH, TOKENS_SECOND, TOKENS_PAGE = 14, 25, 256
PART = "struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2")


def _role(role: Column) -> Column:
    """A role is one line: its backslashes and line feeds are escaped before its control strings."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    plain = F.split(unescape(role), r"\\\\", -1)  # between doubled backslashes, \n stands for a line feed
    return F.array_join(F.transform(plain, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_part(text: Column) -> Column:
    """The parts of a message that is only a text."""
    null = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), null.cast("string").alias("ref"), null.cast("int").alias("width"), null.cast("int").alias("height"), null.cast("double").alias("seconds"), null.cast("int").alias("pages")))


def _placeholder(part: Column) -> Column:
    return F.coalesce(*[F.when(part["type"] == kind, F.lit(mark)) for kind, mark in PLACEHOLDERS.items()])


def _visit(parts: Column) -> Column:
    """The text of a message's parts in their order. Texts between two attachments are joined before they are escaped, so that no control string comes together from several."""
    at = F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: _placeholder(F.get(parts, i)).isNotNull())  # one place more than there are parts

    def piece(k: Column) -> Column:
        low, high = F.coalesce(F.get(at, k - 1) + 1, F.lit(0)), F.coalesce(F.get(at, k), F.size(parts))
        said = F.array_join(F.transform(F.slice(parts, low + 1, high - low), lambda p: F.coalesce(p["text"], F.lit(""))), "")
        return F.concat(escape(said), F.coalesce(_placeholder(F.get(parts, high)), F.lit("")))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.size(at)), piece), "")


def _tokens(part: Column) -> Column:
    """Tokens that an attachment's placeholder expands to, 0 for text; at least 1 for an attachment of unknown size."""
    image = F.ceil(F.coalesce(part["width"], F.lit(1)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(1)) / PATCH)
    audio = F.greatest(F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * TOKENS_SECOND), F.lit(1))
    pages = F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * TOKENS_PAGE
    return F.when(part["type"] == "image", image).when(part["type"] == "audio", audio).when(part["type"] == "document", pages).otherwise(0).cast("long")


def format_chat(turns: DataFrame, parts: Column, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role") -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, loss_spans array<struct<start, size>> (code points of
    `formatted` that hold an assistant's message), attachments array<struct<turn, part, type, ref, tokens>>, n_parts, expanded_tokens.

    parts: array of PART for each message. Turns go by turn (null first), then role, then output text, so that ties and
    repeated rows have one order and all stay. Null parts, part texts or roles count as empty; a part of another type as
    text. Rows are rendered before they are shuffled, by conversation; places come from a running sum. A null conv_id is
    one conversation; an empty table gives no rows. Other columns are not read.
    """
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    role = F.coalesce(F.col(role_col), F.lit(""))
    found = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))), lambda a: a["type"].isin(*PLACEHOLDERS))
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), (role == "assistant").alias("learn"),
        F.concat(F.lit(BEGIN), _role(role), F.lit("\n")).alias("head"), _visit(parts).alias("body"), found.alias("found"), F.size(parts).alias("n_parts"),
    )
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(END))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "head", "body")
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("at", F.row_number().over(order)).withColumn("start", (before + F.length("head")).cast("long"))
    piece = F.struct("at", F.concat("head", "body", F.lit(END)).alias("shown"), "turn", "start", F.length("body").cast("long").alias("size"), "learn", "found", "n_parts")
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("t"))
    attached = F.flatten(F.transform("t", lambda t: F.transform(t["found"], lambda a: F.struct(t["turn"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return whole.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.array_join(F.transform("t", lambda t: t["shown"]), "").alias("formatted"),
        F.transform(F.filter("t", lambda t: t["learn"]), lambda t: F.struct(t["start"].alias("start"), t["size"].alias("size"))).alias("loss_spans"),
        attached.alias("attachments"), F.aggregate("t", F.lit(0).cast("long"), lambda n, t: n + t["n_parts"]).alias("n_parts"),
        F.aggregate(attached, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of an output: array<struct<role, text>>, unescaped; placeholders stay as they are."""
    pieces = F.filter(F.split(formatted, r"<\|im_end\|>\n", -1), lambda t: F.startswith(t, F.lit(BEGIN)))

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(BEGIN) + 1))
        cut = F.locate("\n", rest)
        return F.struct(_role_back(F.substr(rest, F.lit(1), cut - 1)).alias("role"), unescape(F.substr(rest, cut + 1)).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between. spans as the output has them: in order, one for a turn at most; the output is walked turn by turn, so a long conversation is read once."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    gap = len(END)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).alias("n"), F.array().cast("array<string>").alias("said"))

    def step(done: Column, piece: Column) -> Column:
        after = done["at"] + F.length(piece) + gap
        span = F.get(spans, done["n"])
        here = F.coalesce(span["start"] < after, F.lit(False))
        said = unescape(F.substr(piece, (span["start"] - done["at"] + 1).cast("int"), span["size"].cast("int")))
        return F.struct(after.alias("at"), F.when(here, done["n"] + 1).otherwise(done["n"]).alias("n"), F.when(here, F.concat(done["said"], F.array(said))).otherwise(done["said"]).alias("said"))

    return F.array_join(F.aggregate(pieces, start, step, lambda done: done["said"]), "")
