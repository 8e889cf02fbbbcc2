"""Quality rules and n-gram perplexity.

Rules look at a document alone. What passes them is counted: for each language a modified Kneser-Ney model of n-grams of
code points, running on across the ends of words, is made from counts that Spark gathers over the whole corpus, and kept in
sorted arrays of n-gram keys. A text counts once in its language, in the model and in the bands, however many copies of it
there are. Every document gets its perplexity under its language's model, and those outside their language's band are
rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._tables import cut, enter, skew_join, small_batches
from ._words import Words, groups

#: Order of the model and bits of a symbol.
ORDER, BITS = 5, 7
#: The bands: median of log-perplexity minus and plus so many deviations (1.4826 times the median absolute deviation, at least MIN_DEVIATION).
LOWER, UPPER, MIN_DEVIATION = 8.0, 8.0, 0.05
#: Where a language has so many labelled good texts, its band is also drawn from them: of these, such a share may lie beyond either end.
LEAST_GOOD, BEYOND = 200, 0.005
#: What is broadcast for one pass over the texts: models of several languages up to so many bytes, or a part of one language's model.
MODEL_BYTES = 48_000_000
#: Bytes of an n-gram in memory (key and value, in up to two arrays); kinds summed in a task before they are sent on.
GRAM_BYTES, HELD_GRAMS = 24, 500_000
#: Up to so many languages their bands (a row each) are broadcast.
BROADCAST_LANGUAGES = 10_000
#: Texts that may have copies are found by so many slots of their hashes, which bounds what is broadcast; texts that share a slot by chance do no harm.
SLOTS = 1 << 20
#: Rules: fewest words, and the most of 100 words that may stand in repeated windows of WINDOW words.
MIN_WORDS, MAX_REPEATED, WINDOW = 20, 30, 8
_MIDDLE = (1 << BITS * (ORDER - 2)) - 1


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """The symbol of each code point: 0 is the edge of a word; letters a to z in either case, digits as one, each sign of ASCII; other letters in lower case by their place modulo 56, so that those of one alphabet differ; other characters modulo 11."""
    table = np.zeros(0x110000, np.uint8)
    for point in range(0x110000):
        char = chr(point)
        if point < 128:
            lower = char.lower()
            table[point] = ord(lower) - 96 if lower.isalpha() else 27 if char.isdigit() else 0
        elif char.isalpha():
            table[point] = 61 + ord(char.lower()[0]) % 56
        else:
            table[point] = 117 + point % 11
    signs = [p for p in range(128) if chr(p).isprintable() and not chr(p).isalnum() and p != 32]
    table[signs] = np.arange(28, 60)
    table[[p for p in range(128) if not chr(p).isprintable()]] = 60
    table[[9, 10, 11, 12, 13, 32]] = 0
    return table


_NOISE = np.zeros(256, bool)
_NOISE[list(b"#*$%&|<>")] = True
_FIRST = np.ones(256, bool)
_FIRST[0x80:0xC0] = False


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[offsets[1:]] - total[offsets[:-1]]


def base_metrics(words: Words, texts: list[str]) -> dict[str, np.ndarray]:
    """The rules' figures of each text."""
    n = np.diff(words.bounds)
    chars = _sums(_FIRST[words.data], words.offsets) - _sums(((words.data >= 9) & (words.data <= 13)) | (words.data == 32), words.offsets)
    hashes, whole = words.windows(WINDOW)
    repeated = np.zeros(len(texts), np.int64)
    lines = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        a, b = words.bounds[i], words.bounds[i + 1]
        if b - a > WINDOW:
            own = hashes[a : b - WINDOW + 1]
            order = np.argsort(own, kind="stable")
            same = own[order[1:]] == own[order[:-1]]
            if same.any():
                edge = np.zeros(b - a + 1, np.int64)
                at = np.unique(np.concatenate((order[1:][same], order[:-1][same])))
                edge[at] += 1
                edge[at + WINDOW] -= 1
                repeated[i] = int((np.cumsum(edge)[:-1] > 0).sum())
        if "\n" in text:
            full = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
            lines[i] = len(full) - len(set(full))
    return {"n_words": n, "word_chars": chars, "n_symbols": _sums(_NOISE[words.data], words.offsets), "n_dup_lines": lines, "n_repeat_words": repeated, "base_failed": (n < MIN_WORDS) | (100 * repeated > MAX_REPEATED * n)}


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all n-grams of some texts (UTF-8 bytes, and where each begins and the last ends), and the text of each.

    A text is its words' symbols with an edge after each word; before it stand as many edges as the order asks.
    """
    data = data[: offsets[-1]]
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    found = symbols()[np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)]
    begin = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
    filled = np.flatnonzero(np.diff(begin))
    first, last = begin[filled], begin[filled + 1] - 1
    keep = found > 0
    after = np.zeros(len(found), bool)
    after[1:] = keep[:-1]
    after[first] = False
    keep |= after  # of white space after a word the first
    rank = np.cumsum(keep)
    before = rank[first] - keep[first]
    kept = rank[last] - before
    sizes = kept + (found[last] > 0)  # a word that ends the text has its edge too
    block = np.concatenate(([0], np.cumsum(sizes + ORDER - 1)))
    text = np.repeat(np.arange(len(filled)), sizes)
    place = np.arange(len(text)) + (text + 1) * (ORDER - 1)
    line = np.zeros(block[-1] + 1, np.uint64)
    line[np.arange(int(kept.sum())) + np.repeat(block[:-1] + ORDER - 1 - before, kept)] = found[keep]
    key = line.copy()
    for k in range(1, ORDER):
        key[k:] |= line[:-k] << np.uint64(BITS * k)
    return key[place], filled[text]


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the highest order, summed in the task; sent on whenever a language has HELD_GRAMS kinds."""
    enter("quality")
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def out(lang: str) -> pa.RecordBatch:
        keys, counts = _merged(held.pop(lang))
        return pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": pa.array(keys.astype(np.int64)), "n": pa.array(counts)})

    for batch in batches:
        langs = np.array(batch.column(2).to_pylist(), object)
        for first, last, words in groups(batch.column(1)):
            fine = ~base_metrics(words, [""] * (last - first))["base_failed"]
            here = langs[first:last]
            keys, text = ngrams(words.data, words.offsets)
            for lang in set(here[fine]):
                own, n = np.unique(keys[(fine & (here == lang))[text]], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((own, n))
                if sum(len(k) for k, _ in parts) > 2 * HELD_GRAMS:
                    held[lang] = [_merged(parts)]
                    if len(held[lang][0][0]) > HELD_GRAMS:
                        yield out(lang)
    for lang in list(held):
        yield out(lang)


def kneser_ney(counts: DataFrame, once: bool = False) -> DataFrame:
    """From (lang, gram, n) of the highest order: (lang, n_order, key, share, rest) of the n-grams and contexts that say something.

    share is the discounted probability of the n-gram's last symbol after its context; null stands for 0. rest is what the
    context (key, as a context of n_order symbols) leaves to the next lower order; null stands for 1. Lower orders count the
    kinds of symbols seen before. The discounts are those of the modified method, by language and order from the numbers of
    n-grams seen once to four times. once: whether that holds for what was seen once, too; else this is discounted wholly above
    the lowest order, as in texts that were counted themselves such an n-gram is evidence of the text about itself.
    Each order's counts, and its discounts, are written before the next are drawn from them: in one plan every order would hold those above it, which the driver would plan anew after each stage.
    """
    level = cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    parts = []
    for order in range(ORDER, 0, -1):
        mask = (1 << BITS * (order - 1)) - 1
        seen = level.groupBy("lang").agg(*[F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)])
        y = F.when(F.col("n1") + F.col("n2") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)
        off = lambda k, y=y: F.least(F.greatest(F.when(F.col(f"n{k}") > 0, k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")).otherwise(0.5), F.lit(0.05)), F.lit(k - 0.05))
        seen = cut(seen.select("lang", (off(1) if once or order == 1 else F.lit(1.0)).alias("d1"), off(2).alias("d2"), off(3).alias("d3")))
        rows = level.join(F.broadcast(seen), "lang").withColumn("less", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.shiftrightunsigned("gram", BITS)
        whole = Window.partitionBy("lang", "context")
        rows = rows.withColumn("context", context).withColumn("total", F.sum("n").over(whole)).withColumn("left", F.sum("less").over(whole))
        shares = rows.where(F.col("n") > F.col("less")).select("lang", F.lit(order).alias("n_order"), F.col("gram").alias("key"), ((F.col("n") - F.col("less")) / F.col("total")).alias("share"), F.lit(None).cast("double").alias("rest"))
        rests = rows.where(F.col("left") < F.col("total")).groupBy("lang", "context").agg((F.first("left") / F.first("total")).alias("rest"))
        parts += [shares, rests.select("lang", F.lit(order - 1).alias("n_order"), F.col("context").alias("key"), F.lit(None).cast("double").alias("share"), "rest")]
        if order > 1:
            level = cut(level.groupBy("lang", F.col("gram").bitwiseAND(mask).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("lang", "n_order", "key").agg(F.max("share").alias("share"), F.max("rest").alias("rest"))


class Model:
    """One language's model in sorted arrays of keys: for each order the shares, and the rests of its contexts."""

    def __init__(self) -> None:
        self.shares: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.rests: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, order: int, keys: np.ndarray, share: np.ndarray, rest: np.ndarray) -> None:
        by = np.argsort(keys)
        keys, share, rest = keys[by].astype(np.uint64), share[by], rest[by]
        self.shares[order] = keys[~np.isnan(share)], share[~np.isnan(share)].astype(np.float32)
        self.rests[order] = keys[~np.isnan(rest)], rest[~np.isnan(rest)].astype(np.float32)

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray] | None, keys: np.ndarray, default: float) -> np.ndarray:
        if table is None or not len(table[0]):
            return np.full(len(keys), default)
        at = np.minimum(np.searchsorted(table[0], keys), len(table[0]) - 1)
        return np.where(table[0][at] == keys, table[1][at], default)

    def log_prob(self, keys: np.ndarray) -> np.ndarray:
        """Log-probability of the last symbol of each n-gram of the highest order. What was never seen gets its share of the uniform distribution."""
        p = np.full(len(keys), 1.0 / (1 << BITS))
        for order in range(1, ORDER + 1):
            own = keys & np.uint64((1 << BITS * order) - 1)
            p = self._find(self.shares.get(order), own, 0.0) + self._find(self.rests.get(order - 1), own >> np.uint64(BITS), 1.0) * p
        return np.log(np.maximum(p, 1e-12))


def _bucket(middle, parts: int):
    """The part of a language's model that scores the places with these middle symbols; of a Column or an array of numbers."""
    mixed = middle * 2654435761
    return (mixed >> np.uint64(16)) % np.uint64(parts) if isinstance(middle, np.ndarray) else F.shiftright(mixed, 16) % parts


def _arrays(rows: DataFrame, langs: list[str]) -> dict[str, Model]:
    """The sorted arrays of some languages, fetched one language after another."""
    made = {}
    for lang in langs:
        own = rows.where(F.col("lang") == lang).select(F.col("n_order").cast("tinyint"), "key", F.col("share").cast("float"), F.col("rest").cast("float")).toArrow()
        order, keys, share, rest = (own.column(k).to_numpy() for k in range(4))
        made[lang] = Model()
        for k in range(ORDER + 1):
            mine = order == k
            made[lang].add(k, keys[mine], share[mine], rest[mine])
        del own, order, keys, share, rest
        pa.default_memory_pool().release_unused()
    return made


def _models(spark, model: DataFrame) -> Iterator[tuple[dict[str, tuple[int, int]], object]]:
    """Models broadcast in turn: for each pass the languages with their part and number of parts, and the sorted arrays.

    What a pass broadcasts is bounded by MODEL_BYTES and, for each language, the bounded lower orders: a larger model is cut
    into parts by a hash, and a pass scores those places of the texts that its part is about.
    """
    high = F.col("n_order") >= ORDER - 1
    counted = model.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(high).alias("high")).collect()
    size = {r["lang"]: r["n"] * GRAM_BYTES for r in counted}
    parts = {r["lang"]: max(1, -(-r["high"] * GRAM_BYTES // MODEL_BYTES)) for r in counted}
    together: list[dict[str, tuple[int, int]]] = []
    room = MODEL_BYTES
    for lang in sorted(size):
        if parts[lang] > 1:
            together += [{lang: (k, parts[lang])} for k in range(parts[lang])]
            room = MODEL_BYTES
        elif room + size[lang] > MODEL_BYTES:
            together.append({lang: (0, 1)})
            room = size[lang]
        else:
            together[-1][lang] = (0, 1)
            room += size[lang]
    for langs in together:
        rows = model.where(F.col("lang").isin(list(langs)))
        part, n = max(langs.values())
        if n > 1:  # shares go by the symbols before the last, contexts by their last ones: those that a place's n-gram has between its first and last
            inside = lambda shift: F.shiftrightunsigned("key", shift).bitwiseAND(_MIDDLE)
            rows = rows.where(~high | (F.col("share").isNotNull() & (_bucket(inside(BITS), n) == part)) | (F.col("rest").isNotNull() & (_bucket(inside(0), n) == part)))
        yield langs, spark.sparkContext.broadcast(_arrays(rows, list(langs)))


def each_once(rows: DataFrame) -> DataFrame:
    """One row (doc_id, text, lang) of each text in a language. Only texts whose slot has a copied text are shuffled, each once from a task; the others stay where they are."""
    keys = rows.groupBy("lang", "hash", "hash2").agg(F.count(F.lit(1)).alias("n"))
    slot = F.pmod("hash", F.lit(SLOTS))
    slots = F.broadcast(cut(keys.where("n > 1").select(slot.alias("slot")).distinct()))
    rows = rows.withColumn("slot", slot)
    copied = rows.join(slots, "slot", "left_semi").groupBy("lang", "hash", "hash2").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return rows.join(slots, "slot", "left_anti").select("doc_id", "text", "lang").unionByName(copied.select("doc_id", "text", "lang"))


def _totals(words: Words, here: np.ndarray, langs: dict[str, tuple[int, int]], models: dict[str, Model]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text the log-probability of its symbols that a pass is about, and how many symbols it has; languages of other passes have 0."""
    total, count = np.zeros(len(here)), np.zeros(len(here), np.int64)
    wanted = set(here) & set(langs)
    if not wanted:
        return total, count
    keys, text = ngrams(words.data, words.offsets)
    for lang in wanted:
        of_lang = (here == lang)[text]
        own, whose = keys[of_lang], text[of_lang]
        count += np.bincount(whose, minlength=len(here))
        part, n = langs[lang]
        if n > 1:
            mine = _bucket(own >> np.uint64(BITS) & np.uint64(_MIDDLE), n) == part
            own, whose = own[mine], whose[mine]
        found, back = np.unique(own, return_inverse=True)
        total += np.bincount(whose, models[lang].log_prob(found)[back], len(here))
    return total, count


def _score(langs: dict[str, tuple[int, int]], shared):
    """The rules' figures and what the pass says of each text; of texts of which it is not the first pass, only the latter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        models: dict[str, Model] = shared.value if shared else {}
        for batch in batches:
            here_all = np.array(batch.column(2).to_pylist(), object)
            for first, last, words in groups(batch.column(1)):
                here = here_all[first:last]
                out = base_metrics(words, batch.column(1).slice(first, last - first).to_pylist())
                total, count = _totals(words, here, langs, models)
                pieces = {k: pa.array(v.astype(bool) if k == "base_failed" else v.astype(np.int64)) for k, v in out.items()}
                pick = {k: batch.column(i).slice(first, last - first) for k, i in (("doc_id", 0), ("row", 3), ("lang", 2), ("hash", 4), ("hash2", 5))}
                yield pa.RecordBatch.from_pydict(pick | pieces | {"total": pa.array(total), "count": pa.array(count)})

    return run


def _more(langs: dict[str, tuple[int, int]], shared):
    """What a further pass over a language says of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("quality")
        for batch in batches:
            here = np.array(batch.column(1).to_pylist(), object)
            for first, last, words in groups(batch.column(0)):
                total, _ = _totals(words, here[first:last], langs, shared.value)
                yield pa.RecordBatch.from_pydict({"row": batch.column(2).slice(first, last - first), "part": pa.array([langs[x][0] for x in here[first:last]], pa.int64()), "more": pa.array(total)})

    return run


def _with_lang(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    """rows with the columns of a table that has a row for each language."""
    return rows.join(F.broadcast(table), "lang", "left") if few else skew_join(rows, table, ["lang"], "left")


def _quantiles(rows: DataFrame, value: str, **shares: float) -> DataFrame:
    """(lang, a column for each share): the least bin of a thousandth up to which a language has that share of its rows, exactly; and `n`, its rows."""
    bins = rows.groupBy("lang", F.round(F.col(value) * 1000).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("lang")
    bins = bins.withColumn("upto", F.sum("n").over(w.orderBy("bin"))).withColumn("all", F.sum("n").over(w))
    found = (F.min(F.when(F.col("upto") >= F.lit(share) * F.col("all"), F.col("bin") / 1000)).alias(name) for name, share in shares.items())
    return cut(bins.groupBy("lang").agg(*found, F.first("all").alias("n")))


def bands(scored: DataFrame, lower: float = LOWER, upper: float = UPPER, few: bool = True, labels: DataFrame | None = None) -> DataFrame:
    """(lang, low, high) of log-perplexity from the distinct texts (lang, hash, hash2) that pass the rules: exact medians over bins of a thousandth.

    labels (doc_id, quality; a document counts as good if any label says 1): in a language with LEAST_GOOD good texts the band ends where a share of BEYOND of these lie
    below or above, if that is narrower; all labelled texts are looked at, each once.
    """
    good = cut(scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).groupBy("lang", "hash", "hash2").agg(F.first("log_ppl").alias("log_ppl")))
    middle = _quantiles(good, "log_ppl", middle=0.5).drop("n")
    spread = _quantiles(_with_lang(good, middle, few).withColumn("off", F.abs(F.col("log_ppl") - F.col("middle"))), "off", spread=0.5).drop("n")
    wide = F.greatest(1.4826 * F.col("spread"), F.lit(MIN_DEVIATION))
    out = middle.join(spread, "lang").select("lang", (F.col("middle") - lower * wide).alias("low"), (F.col("middle") + upper * wide).alias("high"))
    if labels is None:
        return out
    clean = labels.where("doc_id IS NOT NULL AND quality = 1").select("doc_id").distinct()
    known = scored.where(~F.col("base_failed") & F.col("log_ppl").isNotNull()).select("doc_id", "lang", "hash", "hash2", "log_ppl").join(clean, "doc_id", "left_semi")
    ends = _quantiles(known.groupBy("lang", "hash", "hash2").agg(F.first("log_ppl").alias("log_ppl")), "log_ppl", least=BEYOND, most=1 - BEYOND).where(F.col("n") >= LEAST_GOOD).drop("n")
    return out.join(ends, "lang", "left").select("lang", F.greatest("low", F.col("least") - 0.001).alias("low"), F.least("high", F.col("most") + 0.001).alias("high"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", lower: float = LOWER, upper: float = UPPER, labels: DataFrame | None = None, once: bool = False) -> DataFrame:
    """For each row: doc_id, row (hash of id, text and language), the rules' figures, base_failed, perplexity, kept. labels: see bands(); once: see kneser_ney().

    Texts are read to find copies, to count and to score. Those that may have copies are shuffled, one of each from a task, so
    that each counts once; else only n-gram counts, summed in each task first, and narrow rows of documents are. Null text: empty, fails the rules. Null language: a language of its own ("und").
    Repeated rows give repeated results, null ids stay null, an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    text, lang = F.coalesce(F.col(text_col), F.lit("")), F.coalesce(F.col(lang_col), F.lit("und"))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), lang.alias("lang"), F.xxhash64(F.col(id_col), text, lang).alias("row"), F.xxhash64(text).alias("hash"), F.xxhash64(F.lit(1), text).alias("hash2"))
    model = cut(kneser_ney(each_once(rows).mapInArrow(_count, "lang string, gram bigint, n bigint"), once))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, row bigint, lang string, hash bigint, hash2 bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, total double, count bigint"
    done, scored, more, sent = [], None, None, []
    for langs, shared in _models(spark, model):
        sent.append(shared)
        own = rows.where(F.col("lang").isin(list(langs)))
        if max(langs.values())[0] > 0:  # the first part has what else there is to a text
            part = own.select("text", "lang", "row").mapInArrow(_more(langs, shared), "row bigint, part bigint, more double")
            more = part if more is None else more.unionByName(part)
            continue
        part = own.mapInArrow(_score(langs, shared), schema)
        scored = part if scored is None else scored.unionByName(part)
        done += langs
    rest = rows.where(~F.col("lang").isin(done)) if done else rows
    rest = rest.mapInArrow(_score({}, None), schema)  # languages of which no document passes the rules
    scored = rest if scored is None else scored.unionByName(rest)
    if more is not None:
        more = more.groupBy("row", "part").agg(F.first("more").alias("more")).groupBy("row").agg(F.sum("more").alias("more"))
        scored = skew_join(scored, more, ["row"], "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("more")
    scored = cut(scored.withColumn("log_ppl", F.when(F.col("count") > 0, -F.col("total") / F.col("count"))).drop("total", "count"))
    for shared in sent:
        shared.destroy()
    few = len(done) <= BROADCAST_LANGUAGES
    out = _with_lang(scored, cut(bands(scored, lower, upper, few, labels)), few)
    inside = F.coalesce(F.col("log_ppl").between(F.col("low"), F.col("high")), F.lit(True))
    return out.select("doc_id", "row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.exp("log_ppl").alias("perplexity"))
