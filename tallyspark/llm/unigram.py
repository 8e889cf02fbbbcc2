"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; dynamic programming carries the best score
to each place and the number of pieces on that path, no path itself. Ties go as in the tokenizer: of paths of equal score to
a place, the one whose last piece starts first, and an unknown character only if it is better. Spaces are marked, the text
begins with a mark, and an unknown character counts as its UTF-8 bytes where the vocabulary has byte pieces. No piece holds
a mark after another character, so the best path passes every such place, and each part between them is solved once.

The tokenizer adds scores in 32 bits. With whole numbers as scores those sums are exact up to 2**24, so that neither the parts
nor the order of adding change a tie, and the counts are the tokenizer's own; with other scores it may round ties apart.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from ._tables import enter, id_text, small_batches

MARK = "▁"
#: What an unknown character costs beyond the least score of a piece (fixed value of the tokenizer); parts kept in a worker, and letters of the longest that is kept.
UNKNOWN_PENALTY, MAX_PARTS, KEPT = 10.0, 400_000, 64
_PARTS = re.compile(rf"{MARK}*[^{MARK}]*")


def whole_scores(pieces: dict[str, float]) -> dict[str, float]:
    """Whole numbers as scores, for a vocabulary whose scores are only an order: the binary logarithm of a share that falls with the piece's rank, rounded down.

    The best paths then have few pieces, and frequent ones; the least score of 2**k pieces is -k - 1.
    """
    ranked = sorted(pieces, key=lambda p: (-pieces[p], p))
    return {p: -float((k + 1).bit_length()) for k, p in enumerate(ranked)}


class Counter:
    def __init__(self, pieces: dict[str, float], byte_fallback: bool):
        """pieces: the scores of the normal pieces."""
        self.machine = ahocorasick.Automaton()
        for piece, score in pieces.items():
            self.machine.add_word(piece, (len(piece), score))
        self.machine.make_automaton()
        self.single = frozenset(p for p in pieces if len(p) == 1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.fallback = byte_fallback
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces)
        self.known: dict[str, tuple[float, int, int]] = {}

    @classmethod
    def from_model(cls, path: str, whole: bool = True) -> Counter:
        """The normal pieces of a model file, with their own scores or as whole_scores() has them."""
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        normal = {model.id_to_piece(i): model.get_score(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        return cls(whole_scores(normal) if whole else normal, any(model.is_byte(i) for i in ids))

    def solve(self, part: str) -> tuple[float, int, int]:
        """Best score of a part, pieces on that path, and unknown characters on it."""
        n = len(part)
        best: list[float | None] = [0.0] + [None] * n
        count, odd = [0] * (n + 1), [0] * (n + 1)
        done = 0

        def close(upto: int) -> None:
            nonlocal done
            for end in range(done + 1, upto + 1):  # after all pieces that end there: the single unknown character
                char = part[end - 1]
                if char not in self.single and best[end - 1] is not None:
                    score = best[end - 1] + self.unknown
                    if best[end] is None or score > best[end]:
                        best[end], odd[end] = score, odd[end - 1] + 1
                        count[end] = count[end - 1] + (len(char.encode("utf-8", "surrogatepass")) if self.fallback else 1)
            done = upto

        for last, (size, score) in self.machine.iter(part):
            end = last + 1
            if end - 1 > done:
                close(end - 1)
            start = end - size
            if best[start] is not None:
                score += best[start]
                if best[end] is None or score > best[end]:  # longest first, so that of equals the first start stays
                    best[end], count[end], odd[end] = score, count[start] + 1, odd[start]
        close(n)
        return best[n], count[n], odd[n]

    def count(self, text: str) -> tuple[float, int, int]:
        """Of a whole text."""
        if not text:
            return 0.0, 0, 0
        marked = MARK + text.replace(" ", MARK)
        if not self.cut:
            return self.solve(marked)
        known = self.known
        if len(known) > MAX_PARTS:
            known.clear()
        parts = [MARK + p for p in text.split(" ")] if "  " not in text and text[:1] != " " and text[-1:] != " " and MARK not in text else [p for p in _PARTS.findall(marked) if p]
        found = list(map(known.get, parts))
        if None in found:
            for at, part in enumerate(parts):
                if found[at] is None:
                    found[at] = known.get(part) or self.solve(part)
                    if len(part) <= KEPT:
                        known[part] = found[at]
        scores, counts, odd = zip(*found)
        return float(sum(scores)), sum(counts), sum(odd)


@lru_cache(maxsize=2)
def counter(path: str, whole: bool = True) -> Counter:
    return Counter.from_model(path, whole)


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", whole: bool = True) -> DataFrame:
    """For each row: doc_id, n_chars, n_tokens, n_unknown (characters without a piece), score (of the best path).

    Narrow: no shuffle. whole: the pieces' scores are whole_scores(); counts are then those of the tokenizer's encode() with
    these scores, for texts whose best score is above -2**24 (some million tokens). Else the model's own, summed in 64 bits. Null text: empty, no tokens. Null ids stay null, repeated rows give repeated results, an empty table gives none; other
    columns are not read. model_path must be readable on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("unigram", counter.cache_clear)
        own = counter(model_path, whole)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            score, n, odd = zip(*map(own.count, texts)) if texts else ((), (), ())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_chars": pa.array(map(len, texts), pa.int64()), "n_tokens": pa.array(n, pa.int64()), "n_unknown": pa.array(odd, pa.int64()), "score": pa.array(score, pa.float64())})

    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_chars bigint, n_tokens bigint, n_unknown bigint, score double")
