"""Alignment of two tokenizers over a corpus.

Both tokenizers cut the same bytes, so a token of one and a token of the other are linked where their byte ranges overlap.
An id pair is packed into one 64-bit key; each task counts its keys by np.unique, a global sort over ranges of the key sums
the partial counts, and the sorted counts are looked up by binary search in memory-mapped shards.

Neither tokenizer joins a character to a space behind it when that space begins a word, so a text is cut before such spaces,
and what can be said of each part (ids, links, groups) is found once and kept in the worker.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._counts import COUNT_ROWS, Partial, Shards, sorted_shards
from ._pieces import PATTERN
from ._tables import enter, id_text, small_batches, some_texts

MARK = "▁"
#: Bounds of what a worker keeps of parts: their number, and bytes of their texts and groups. Bytes given to a tokenizer at once.
MAX_PARTS, MAX_BYTES, AT_ONCE = 400_000, 96 << 20, 1 << 14
#: A space that follows something else and begins a word; a text without the other kind of space splits at each of its spaces.
_WORD, _OTHER = re.compile(r"(?<=[^ ]) (?=\S)"), re.compile(r"\A | (?!\S)")
#: Letters that all versions of the character tables put into one class.
_UNSURE = re.compile("[^\\x00-\u024f\u0400-\u045f\u2010-\u2027\u2030-\u205e\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5]")
SEPARATORS = ",|;"
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
_held: dict[tuple[str, str], Pair] = {}


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """Both tokenizers, with the bytes of each id."""

    def __init__(self, byte_level: str, pieces: str):
        import sentencepiece

        self.file = byte_level
        with open(byte_level, encoding="utf-8") as f:
            held = json.load(f)
        letters = _byte_letters()
        self.a_bytes = [b""] * (1 + max([*held["model"]["vocab"].values(), *(x["id"] for x in held["added_tokens"])], default=-1))
        for token, k in held["model"]["vocab"].items():
            self.a_bytes[k] = bytes(map(letters.__getitem__, token)) if letters.keys() >= set(token) else token.encode()
        splits, special = held["pre_tokenizer"], [x["id"] for x in held["added_tokens"]]
        usual = splits is not None and splits["type"] == "ByteLevel" and held["normalizer"] is None
        self.fast = None
        if usual:  # ids of such a vocabulary are ranks of its merges
            import tiktoken

            ranks = {x: k for k, x in enumerate(self.a_bytes) if x and k not in special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
            del ranks
        del held
        for k in special:
            self.a_bytes[k] = b""  # their strings in a text are plain text, so these ids never occur
        self.slow = None
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        named = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(named)]
        self.cuts = usual and not any(MARK in p.lstrip(MARK) for p in named)
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.shown = [f"{k}{s}" for k in range(max(len(self.a_bytes), len(self.b_bytes))) for s in SEPARATORS]

    def parts(self, text: str) -> list[str]:
        """The text with a space before it, cut before each word, those spaces left out."""
        if not self.cuts:
            return [text]
        return _WORD.split(text) if _OTHER.search(text) else text.split(" ")

    def encode_a(self, text: str) -> np.ndarray:
        """By the tokenizer's own library where the text has letters of which the libraries' tables may say different things."""
        if self.fast is not None and not _UNSURE.search(text):
            return np.array(self.fast.encode_ordinary(text), np.int64)
        if self.slow is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.file)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.int64)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which parts both tokenizers give back, and the ids of those, part after part.

        Parts that end in no white space are joined again, in another order, which changes no token; the bytes tell whether they come back.
        """
        whole, a, b = np.ones(len(parts), bool), [], []
        first = 0
        while first < len(parts):
            last, size = first, 0
            while last < len(parts) and (last == first or size < AT_ONCE and self.cuts and not parts[last - 1][-1:].isspace()):
                size += len(parts[last])
                last += 1
            own = self._whole(" ".join(parts[first:last]))
            if own is None and last > first + 1:  # one of them does not come back
                for k in range(first, last):
                    own = self._whole(parts[k])
                    whole[k] = own is not None
                    a, b = ([*a, own[0]], [*b, own[1]]) if own else (a, b)
            else:
                whole[first:last] = own is not None
                a, b = ([*a, own[0]], [*b, own[1]]) if own else (a, b)
            first = last
        none = np.zeros(0, np.int64)
        return whole, np.concatenate([none, *a]), np.concatenate([none, *b])

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        full = " " + text
        a, b, want = self.encode_a(full), self.b.encode(text, num_threads=1), full.encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) == want == b"".join(map(self.b_bytes.__getitem__, b)):
            return a, np.array(b, np.int64)
        return None


def links(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed key of each link, B's id above A's, and the byte offset at which it ends: one for each stretch between two neighbouring cuts."""
    ends = np.union1d(a_ends, b_ends)
    return (b[np.searchsorted(b_ends, ends)] << 32) | a[np.searchsorted(a_ends, ends)], ends


class Known:
    """What is known of parts of texts; emptied when full. lookup and best: corpus-wide counts, and the highest of each B id."""

    def __init__(self, pair: Pair, shards: Shards | None = None, best: np.ndarray | None = None):
        self.pair, self.best = pair, best
        self.lookup = shards.open() if shards else None
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[str] = []
        self.bytes = 0
        self.numbers = np.zeros((0, 7), np.int64)  # whole, A tokens, B tokens, groups, links, best links, sum of counts
        self.keys: list[np.ndarray] = []  # of links, for each addition
        self.owner: list[np.ndarray] = []

    def full(self) -> bool:
        return len(self.groups) > MAX_PARTS or self.bytes > MAX_BYTES

    def rows(self, parts: list[str]) -> np.ndarray:
        """The row of each part in numbers."""
        found = np.fromiter(map(self.at.get, parts, repeat(-1)), np.int64, len(parts))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            self._add(list(dict.fromkeys(parts[k] for k in missing)))
            found[missing] = [self.at[parts[k]] for k in missing]
        return found

    def _add(self, new: list[str]) -> None:
        pair, base = self.pair, len(self.groups)
        self.at.update(zip(new, range(base, base + len(new))))
        whole, a, b = pair.encode(new)
        numbers = np.zeros((len(new), 7), np.int64)
        numbers[:, 0] = whole
        fine = np.flatnonzero(whole)
        a_ends, b_ends = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
        sizes = np.array([1 + (len(p) if p.isascii() else len(p.encode())) for p in new], np.int64)
        text_ends = np.cumsum(sizes[fine])
        n_a, n_b = (np.diff(np.searchsorted(x, text_ends, "right"), prepend=0) for x in (a_ends, b_ends))
        keys, ends = links(a, b, a_ends, b_ends)
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        of_link = np.searchsorted(text_ends, ends)
        numbers[fine, 1], numbers[fine, 2] = n_a, n_b
        numbers[fine, 3] = np.bincount(np.searchsorted(text_ends, both), minlength=len(fine))
        numbers[fine, 4] = np.bincount(of_link, minlength=len(fine))
        shown = [""] * len(new)
        if self.lookup is not None:
            for k, text in zip(fine.tolist(), self._groups(a, b, a_ends, b_ends, both, n_a + n_b)):
                shown[k] = text
            own, back = np.unique(keys, return_inverse=True)
            count = self.lookup.get(own)
            top = count == self.best[own >> 32]
            numbers[fine, 5] = np.bincount(of_link, top[back], len(fine))
            sums = np.append(0, np.cumsum(count[back]))
            numbers[fine, 6] = np.diff(sums[np.searchsorted(of_link, np.arange(len(fine) + 1))])
        else:
            self.keys.append(keys)
            self.owner.append((fine[of_link] + base).astype(np.int32))
        self.groups += shown
        self.numbers = np.concatenate([self.numbers, numbers])
        self.bytes += int(sizes.sum()) + sum(map(len, shown)) + 12 * len(keys)

    def _groups(self, a, b, a_ends, b_ends, both, sizes) -> Iterator[str]:
        """For each part the ids of its groups, each followed by its separator."""
        of_a, of_b = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        shown = np.empty(len(a) + len(b), np.int64)
        same = lambda g: np.append(g[1:] == g[:-1], False)[: len(g)]
        shown[np.arange(len(a)) + np.searchsorted(of_b, of_a)] = a * 3 + np.where(same(of_a), 0, 1)
        shown[np.arange(len(b)) + np.searchsorted(of_a, of_b, "right")] = b * 3 + np.where(same(of_b), 0, 2)
        texts = list(map(self.pair.shown.__getitem__, shown.tolist()))
        start = 0
        for n in sizes.tolist():
            yield "".join(texts[start : start + n])
            start += n

    def link_counts(self, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of all links, and how often each occurs if part k does times[k] times."""
        if not self.keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(self.keys), times[np.concatenate(self.owner)]


def _pair(byte_level: str, pieces: str) -> Pair:
    if (byte_level, pieces) not in _held:
        _held.clear()
        _held[byte_level, pieces] = Pair(byte_level, pieces)
    return _held[byte_level, pieces]


def _texts(known: Known, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows of all parts of some texts, where each text's begin and end, and whether both tokenizers give its bytes back."""
    cut_up = [known.pair.parts(t) if t else [] for t in texts]
    bounds = np.cumsum([0, *map(len, cut_up)])
    at = known.rows([p for parts in cut_up for p in parts])
    odd = np.append(0, np.cumsum(known.numbers[at, 0] == 0))
    return at, bounds, (odd[bounds[1:]] == odd[bounds[:-1]]) & (bounds[1:] > bounds[:-1])


def pair_counts(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[Shards, np.ndarray]:
    """The shards of corpus-wide counts of linked id pairs, and the highest count of each B id (bounded by the vocabulary)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("alignment", _held.clear)
        known, partial = Known(_pair(byte_level, pieces)), Partial()
        times = np.zeros(0)

        def flush() -> None:
            keys, n = known.link_counts(times)
            if len(keys):
                partial.add(keys, n)
            known.clear()

        def out() -> Iterator[pa.RecordBatch]:
            keys, n = partial.take()
            for k in range(0, len(keys), COUNT_ROWS):
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys[k : k + COUNT_ROWS]), "n": pa.array(n[k : k + COUNT_ROWS])})

        for _, texts in some_texts(batches):
            at, bounds, whole = _texts(known, texts)
            own = np.bincount(at[np.repeat(whole, np.diff(bounds))], minlength=len(known.groups))
            own[: len(times)] += times.astype(np.int64)
            times = own
            if known.full():
                flush()
                times = np.zeros(0)
                if partial.full():
                    yield from out()
        flush()
        yield from out()

    def highest(keys: np.ndarray, n: np.ndarray) -> bytes:
        ids = keys >> 32
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        return np.stack([ids[first], np.maximum.reduceat(n, first)], 1).tobytes()

    shards = sorted_shards(id_text(docs, id_col, text_col).mapInArrow(run, "key bigint, n bigint"), highest)
    best = np.zeros(len(_pair(byte_level, pieces).b_bytes), np.int64)
    for note in shards.notes:
        ids, n = np.frombuffer(note, np.int64).reshape(-1, 2).T
        np.maximum.at(best, ids, n)
    shards.notes = []
    return shards, best


def align(docs: DataFrame, byte_level: str, pieces: str, id_col: str = "doc_id", text_col: str = "text", groups: bool = True) -> DataFrame:
    """For each row: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links of a pair that no pair of its B id is above),
    count_sum (of the links' pair counts), groups_sha256 and, if asked for, groups: `A ids|B ids` of each group between common cuts, with ; between.

    A: a byte-level tokenizer's file, on a space and the text; B: a piece model's, which adds that space; both must be
    readable where tasks and the driver run. Null and empty texts, and those whose bytes a tokenizer does not give back, have
    no tokens and no part in the counts. Repeated rows count and come back as often as they are there, null ids stay null, an empty table gives no row,
    other columns are not read. Two narrow passes over the texts; between them one shuffle of partial counts.
    """
    shards, best = pair_counts(docs, byte_level, pieces, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("alignment", _held.clear)
        known = Known(_pair(byte_level, pieces), shards, best)
        for ids, texts in some_texts(batches):
            if known.full():
                known.clear()
            at, bounds, whole = _texts(known, texts)
            sums = np.zeros((len(at) + 1, 6), np.int64)
            np.cumsum(known.numbers[at, 1:], 0, out=sums[1:])
            sums = np.where(whole[:, None], sums[bounds[1:]] - sums[bounds[:-1]], 0)
            shown = ["".join(map(known.groups.__getitem__, at[s:e].tolist()))[:-1] if w else "" for s, e, w in zip(bounds[:-1], bounds[1:], whole)]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in shown]
            last = {"groups_sha256": pa.array(digests, pa.string())} | ({"groups": pa.array(shown, pa.string())} if groups else {})
            yield pa.RecordBatch.from_pydict({"doc_id": ids, **{c: pa.array(sums[:, k]) for k, c in enumerate(NUMBERS)}, **last})

    kind = docs.schema[id_col].dataType.simpleString()
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in NUMBERS)}, groups_sha256 string{', groups string' if groups else ''}")
