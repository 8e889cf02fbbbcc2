"""Cutting long texts into overlapping chunks at the largest separators that fit.

A text is cut before every separator of the first kind it holds; what is still too long is cut at the next kind, down to single
characters. Neighbouring pieces are then put together again up to the size, and a chunk takes over from the one before it as
many last pieces as the overlap allows. Pieces keep their separators, so every chunk is a stretch of the text.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Paragraphs, lines, words, characters.
SEPARATORS = ("\n\n", "\n", " ", "")


def pieces(text: str, start: int, end: int, separator: str) -> Iterator[tuple[int, int]]:
    """The stretches of text[start:end] that begin at its separators."""
    if not separator:
        yield from ((k, k + 1) for k in range(start, end))
        return
    while start < end:
        # the separator that a piece begins with is not looked at again, though one may begin inside it
        stop = text.find(separator, start + 1, end)
        stop = end if stop < 0 else stop
        yield start, stop
        start = stop


def merged(found: Iterator[tuple[int, int]], size: int, overlap: int) -> Iterator[tuple[int, int]]:
    """Neighbouring stretches put together up to the size, each beginning with what of the one before is within the overlap and leaves room."""
    held: deque[tuple[int, int]] = deque()
    for start, end in found:
        if held and end - held[0][0] > size:
            yield held[0][0], held[-1][1]
            while held and (held[-1][1] - held[0][0] > overlap or end - held[0][0] > size):
                held.popleft()
        held.append((start, end))
    if held:
        yield held[0][0], held[-1][1]


def spans(text: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS) -> Iterator[tuple[int, int]]:
    """Where the chunks of a text begin and end, in order; none is longer than the size if the last separator is empty.

    Linear in the text for each kind of separator. A piece as long as the size is cut further, like a longer one.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the size and not negative")
    todo = [iter(_runs(text, 0, len(text), size, separators))]
    while todo:  # what is too long goes on top, so the order is that of the text
        step = next(todo[-1], None)
        if step is None:
            todo.pop()
        elif not isinstance(step, tuple):
            yield from merged(iter(step), size, overlap)
        else:
            start, end, rest = step
            if rest:
                todo.append(iter(_runs(text, start, end, size, rest)))
            else:
                yield start, end


def _runs(text: str, start: int, end: int, size: int, separators: Sequence[str]) -> Iterator[Iterable[tuple[int, int]] | tuple[int, int, Sequence[str]]]:
    """Neighbouring pieces that are short enough, and between them the long ones with the separators that are left."""
    at = next((k for k, s in enumerate(separators) if not s or text.find(s, start, end) >= 0), len(separators) - 1)
    if not separators[at] and size > 1:
        yield pieces(text, start, end, "")
        return
    rest = separators[at + 1 :]
    short: list[tuple[int, int]] = []
    for low, high in pieces(text, start, end, separators[at]):
        if high - low < size:
            short.append((low, high))
            continue
        if short:
            yield short
            short = []
        yield low, high, rest
    if short:
        yield short


def chunk_rows(docs: DataFrame, key: str, column: str, size: int = 1000, overlap: int = 200, separators: Sequence[str] = SEPARATORS, strip: bool = True) -> DataFrame:
    """(key, place, start, end, chunk) for every chunk of every text; start and end are places in the whole text.

    strip: chunks lose white space at their ends, and blank ones are left out. Null and empty texts have no rows. Narrow: no shuffle.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of, place, low, high, chunks = batch.column(1), [], [], [], [], []

            def out() -> pa.RecordBatch:
                full = pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int32())), pa.array(place, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(chunks, pa.string())], names=[key, "place", "start", "end", "chunk"])
                for x in (of, place, low, high, chunks):
                    x.clear()
                return full

            for k in range(len(texts)):
                text, n = texts[k].as_py() or "", 0
                for start, end in spans(text, size, overlap, separators):
                    chunk = text[start:end].strip() if strip else text[start:end]
                    if chunk:
                        for x, value in zip((of, place, low, high, chunks), (k, n, start, end, chunk)):
                            x.append(value)
                        n += 1
                if len(chunks) >= 4096:
                    yield out()
            if chunks:
                yield out()

    return docs.select(key, column).mapInArrow(run, f"`{key}` {kind}, place bigint, start bigint, end bigint, chunk string")


def rejoined(chunks: DataFrame, key: str) -> DataFrame:
    """(key, text): the texts again, of chunks that were not stripped; what two chunks share is there once."""
    held = F.sort_array(F.collect_list(F.struct("place", "start", "end", "chunk")))
    before = lambda k: F.when(k > 0, held[k - 1]["end"]).otherwise(F.lit(0))
    new = F.transform(held, lambda x, k: F.substr(x["chunk"], (F.greatest(before(k), x["start"]) - x["start"] + 1).cast("int")))
    return chunks.groupBy(key).agg(F.array_join(new, "").alias("text"))
