"""Spelling variants: words at distance one, found by Aho-Corasick over halves.

A word is cut into two segments. Whatever the one edit between two words is, it leaves one segment of either untouched, at
the beginning or at the end of the other. The segments of all words are dealt to shards by their first (or last) letters, each
shard's segments go into an automaton, and the words that begin (or end) with those letters are scanned by it; what it finds
is kept if the segment lies at the right offset and the lengths differ by one at most, and then the distance is verified.
Letters are those up to U+00FF, so a word is handled as one byte a letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._counts import COUNT_ROWS, batches_of
from ._tables import cut, enter, small_batches, spent

#: Letters and occurrences a word needs; by how much a form must be more frequent; one run in so many loses a letter.
LEAST_LETTERS, LEAST_COUNT, TIMES, EVERY = 6, 5, 5, 199
#: Letters by which segments are dealt (no segment is shorter); words in an automaton; words counted in a task before they are sent on.
DEALT, SHARD, MAX_WORDS = LEAST_LETTERS // 2, 20_000, 400_000
#: Pairs compared at once, and words longer than this one by one.
AT_ONCE, WIDE = 1 << 19, 64
_RUN = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LETTERS)


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): maximal runs of letters, A-Z lowered, by how often they occur, if that is LEAST_COUNT times or more and they have LEAST_LETTERS or more.

    Of the runs of a document (h: crc32 of `id:run`) those with h divisible by EVERY lose the letter at h modulo their length.
    Null texts have none; a null id is an empty one. Counts are summed in each task before one shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        total: Counter[bytes] = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            items = list(total.items())
            total.clear()
            for k in range(0, len(items), COUNT_ROWS):
                some = items[k : k + COUNT_ROWS]
                yield pa.RecordBatch.from_pydict({"word": pa.array([w.decode("latin-1") for w, _ in some], pa.string()), "n": pa.array([n for _, n in some], pa.int64())})

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                start = zlib.crc32(f"{doc}:".encode())
                # other characters become ?, which parts runs as well
                for word, n in Counter(_RUN.findall(text.encode("latin-1", "replace").lower())).items():
                    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), start)
                    if h % EVERY == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < LEAST_LETTERS:
                            continue
                    total[word] += n
            if len(total) > MAX_WORDS:
                yield from out()
        yield from out()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc_id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class Shard:
    """Words with one of their segments each, in an automaton. at_end: whether the segment is the word's second one."""

    def __init__(self, words: list[bytes], n: list[int], at_end: list[bool]):
        self.words, self.n = words, np.array(n, np.int64)
        order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
        self.by_rank = np.array(order, np.int64)
        self.rank = np.empty(len(words), np.int64)
        self.rank[self.by_rank] = np.arange(len(words))
        self.table = Table(words)
        groups: dict[tuple[bool, bytes, int], list[int]] = {}
        for k, (word, end) in enumerate(zip(words, at_end)):
            half = len(word) // 2
            groups.setdefault((end, word[half:] if end else word[:half], len(word)), []).append(k)
        self.members = np.array([k for g in groups.values() for k in g], np.int64)
        self.size = np.array([len(g) for g in groups.values()], np.int64)
        self.first = np.cumsum(self.size) - self.size
        segments: dict[bytes, list[tuple[bool, int, int]]] = {}
        for g, (end, segment, length) in enumerate(groups):
            segments.setdefault(segment, []).append((end, length, g))
        self.machine = ahocorasick.Automaton()
        for segment, found in segments.items():
            self.machine.add_word(segment.decode("latin-1"), (len(segment), found))
        self.machine.make_automaton()

    def hits(self, words: list[bytes], at_end: list[bool]) -> Iterator[tuple[int, int]]:
        """(word, group) for each segment that lies where it does in the group's words, of which none is more than a letter longer or shorter."""
        for u, (word, asked) in enumerate(zip(words, at_end)):
            size = len(word)
            for last, (length, found) in self.machine.iter(word.decode("latin-1")):
                if last + 1 == (size if asked else length):
                    for end, other, g in found:
                        if end == asked and -1 <= other - size <= 1:
                            yield u, g

    def near(self, words: list[bytes], at_end: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """For each word how many of the shard's are near it (found by this segment, and not by the first if this is the second), and the rank of the best of them."""
        count, best = np.zeros(len(words), np.int64), np.full(len(words), len(self.words), np.int64)
        found = np.array(list(self.hits(words, at_end)), np.int64).reshape(-1, 2)
        own, second = Table(words), np.array(at_end, bool)
        sizes = np.cumsum(self.size[found[:, 1]])
        start = 0
        while start < len(found):
            stop = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + AT_ONCE, "right")))
            u, g = found[start:stop].T
            start = stop
            for low in range(0, int(self.size[g].max()), AT_ONCE):  # a group may be larger than what is compared at once
                size = np.clip(self.size[g] - low, 0, AT_ONCE)
                left = np.repeat(u, size)
                place = np.arange(len(left)) - np.repeat(np.cumsum(size) - size, size)
                right = self.members[np.repeat(self.first[g] + low, size) + place]
                left, right, prefix = own.apart(left, self.table, right)
                keep = ~(second[left] & (prefix >= self.table.size[right] // 2))
                left, right = left[keep], right[keep]
                count += np.bincount(left, minlength=len(words))
                np.minimum.at(best, left, self.rank[right])
        return count, best


class Table:
    """Words as rows of bytes, from the left and from the right, and a signature: for each letter whether it occurs an odd number of times."""

    def __init__(self, words: list[bytes]):
        self.words, self.size = words, np.array([len(w) for w in words], np.int64)
        wide = min(WIDE, int(self.size.max(initial=1)))
        rows = lambda pad: np.frombuffer(b"".join(pad(w[:wide], wide, b"\0") for w in words), np.uint8).reshape(-1, wide)
        self.left, self.right = rows(bytes.ljust), rows(bytes.rjust)
        self.odd = np.bitwise_xor.reduce(np.where(self.left > 0, np.uint64(1) << (self.left & 63).astype(np.uint64), np.uint64(0)), 1) if words else np.zeros(0, np.uint64)

    def apart(self, mine: np.ndarray, other: Table, theirs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs that differ by exactly one letter inserted, deleted or replaced, and how many first letters they share."""
        long = np.maximum(self.size[mine], other.size[theirs]) > WIDE
        keep = np.flatnonzero(long | (np.bitwise_count(self.odd[mine] ^ other.odd[theirs]) <= 2))
        mine, theirs, long = mine[keep], theirs[keep], long[keep]
        wide = min(self.left.shape[1], other.left.shape[1])
        same = lambda a, b: np.where((d := a != b).any(1), d.argmax(1), wide)
        prefix = same(self.left[mine, :wide], other.left[theirs, :wide])
        suffix = same(self.right[mine, ::-1][:, :wide], other.right[theirs, ::-1][:, :wide])
        for k in np.flatnonzero(long):  # beyond the rows: letter by letter
            a, b = self.words[mine[k]], other.words[theirs[k]]
            prefix[k], suffix[k] = _shared(a, b), _shared(a[::-1], b[::-1])
        a, b = self.size[mine], other.size[theirs]
        shorter = np.minimum(a, b)
        prefix, suffix = np.minimum(prefix, shorter), np.minimum(suffix, shorter)
        near = (np.abs(a - b) <= 1) & (prefix + suffix >= np.maximum(a, b) - 1) & ~((a == b) & (prefix == a))
        return mine[near], theirs[near], prefix[near]


def _shared(a: bytes, b: bytes) -> int:
    return next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): for each word that has any, the number of words at distance one, and the most frequent of them (ties: the first by code point).

    words (word, n) should be a written table. A word goes to the shard of its first DEALT letters and to that of its last, to be found
    there and to look there. Shards have about SHARD words: letters with more are split, and those who look go to each part;
    the list of such letters has at most 2 rows for SHARD words.
    """
    spark = words.sparkSession
    buckets = 1 + 2 * words.count() // SHARD
    both = words.select("word", "n", F.explode(F.array(F.lit(False), F.lit(True))).alias("at_end"))
    key = F.when(F.col("at_end"), F.right("word", F.lit(DEALT))).otherwise(F.left("word", F.lit(DEALT)))
    both = both.withColumn("letters", key)
    hot = both.groupBy("at_end", "letters").count().where(F.col("count") > SHARD).select("at_end", "letters", F.ceil(F.col("count") / SHARD).cast("int").alias("split"))
    dealt = both.join(F.broadcast(hot), ["at_end", "letters"], "left")
    is_hot = F.col("split").isNotNull()
    dealt = dealt.withColumn("own", F.when(is_hot, F.concat(F.col("at_end").cast("string"), "letters"))).withColumn("bucket", F.pmod(F.xxhash64("at_end", "letters"), F.lit(buckets)))
    last = F.coalesce("split", F.lit(1)) - 1
    held = dealt.select("bucket", "own", F.pmod(F.xxhash64("word"), last + 1).cast("int").alias("part"), F.lit(0).alias("looks"), "word", "n", "at_end")
    looks = dealt.select("bucket", "own", F.explode(F.sequence(F.lit(0), last)).alias("part"), F.lit(1).alias("looks"), "word", "n", "at_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("spelling")
        shard, now, held, looking = None, None, [], []

        def answer() -> Iterator[pa.RecordBatch]:
            nonlocal shard
            if held and looking:
                shard = shard or Shard(*map(list, zip(*held)))
                words, _, at_end = map(list, zip(*looking))
                count, best = shard.near(words, at_end)
                at = np.flatnonzero(count)
                chosen = shard.by_rank[best[at]]
                yield pa.RecordBatch.from_pydict({"word": pa.array([words[k].decode("latin-1") for k in at], pa.string()), "n_near": pa.array(count[at]), "best_n": pa.array(shard.n[chosen]), "best": pa.array([shard.words[k].decode("latin-1") for k in chosen], pa.string())})
            looking.clear()

        for batch in batches:
            for *where, asks, word, n, at_end in zip(*(c.to_pylist() for c in batch.columns)):
                if where != now or len(looking) >= SHARD:
                    yield from answer()
                if where != now:
                    shard, now = None, where
                    held.clear()
                (looking if asks else held).append((word.encode("latin-1"), n, at_end))
        yield from answer()

    rows = held.unionByName(looks).repartition("bucket", "own", "part").sortWithinPartitions("bucket", "own", "part", "looks")
    found = rows.mapInArrow(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("m")
    with batches_of(spark, COUNT_ROWS):
        return cut(found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("m.less")).alias("best_n"), "m.best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): each word's form's form and so on to the last, of (word, form); no word may lead back to itself.

    Each round doubles the steps taken, so the rounds grow with the logarithm of the longest chain.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        after = cut(now.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")))
        spent(now)
        if after.where("moved").isEmpty():
            return after.drop("moved")
        now = cut(after.drop("moved"))
        spent(after)


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each word of word_counts(): word, form, root, n, n_near, form_n.

    form: the most frequent of the words at distance one (ties: the first by code point), if TIMES as frequent as the word;
    form_n: its n; root: the last of the word, its form, the form's form and so on. Repeated rows and null ids count like others, null texts have no words, an empty
    table has none; other columns are not read.
    """
    words = cut(word_counts(docs, id_col, text_col))
    near = near_words(words)
    known = cut(words.join(near, "word", "left").withColumn("is_form", F.col("best_n") >= TIMES * F.col("n")))
    spent(near)
    root = roots(known.where("is_form").select("word", F.col("best").alias("form")))
    form = lambda c: F.when(F.col("is_form"), F.col(c))
    return known.join(root, "word", "left").select("word", form("best").alias("form"), F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form("best_n").alias("form_n"))
