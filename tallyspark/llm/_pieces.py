"""Vectorised splitting of texts into the pieces of the usual byte-level pattern.

The pattern takes, from left to right: a contraction, letters, numbers or other signs with at most one space before them,
white space up to the last one before something else, or that last one. In terms of runs of characters of one class: a run
is a piece; of white space followed by more text the last character is a piece of its own, or belongs to what follows if it
is a space; an apostrophe that is alone and does not follow such a space takes the letters of a contraction from the run
behind it.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# The pattern, and the letters that follow an apostrophe in a contraction.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, LONG = "stmd", ("re", "ve", "ll")
OTHER, LETTER, NUMBER, SPACE = range(4)


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """The class of each code point as the tokenizer's own library has it, whatever version of the character tables that knows: under a pattern that is one class, only its members get ids."""
    import tiktoken

    table = np.zeros(0x110000, np.uint8)
    every = "".join(np.arange(begin, end, dtype=np.uint32).tobytes().decode("utf-32-le") for begin, end in ((0, 0xD800), (0xE000, 0x110000)))
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
        library = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
        members = bytes(library.encode_ordinary(every)).decode()
        table[np.frombuffer(members.encode("utf-32-le"), np.uint32)] = kind
    return table


def split(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of some texts (UTF-8 bytes, and where each text begins and the last ends): first byte, byte after the last, and for text i its pieces bounds[i] to bounds[i + 1]."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    lead = (data & 0xC0) != 0x80
    at_byte = np.append(np.flatnonzero(lead), len(data))
    kind = classes()[points]
    edge = np.zeros(len(points) + 1, bool)  # where a text begins, and the end of all
    edge[np.searchsorted(at_byte, offsets)] = True
    begins = edge[:-1].copy()
    begins[0] = True
    begins[1:] |= kind[1:] != kind[:-1]
    first = np.flatnonzero(begins)
    after = np.append(first[1:], len(points))
    inner = ~edge[after]  # runs that more of the same text follows
    white = (kind[first] == SPACE) & inner
    last = after[white] - 1
    begins[last] = True
    begins[last[points[last] == 32] + 1] = False
    alone = np.flatnonzero((after - first == 1) & (points[first] == ord("'")) & inner)
    alone = alone[begins[first[alone]] & (kind[after[alone]] == LETTER)]
    if len(alone):
        start, stop = after[alone], after[alone + 1]  # of the letters behind
        one, two = points[start], points[np.minimum(start + 1, len(points) - 1)]
        pair = (stop - start > 1) & np.any([(one == ord(a)) & (two == ord(b)) for a, b in LONG], axis=0)
        size = np.where(np.isin(one, [ord(c) for c in SHORT]), 1, 2 * pair)
        start, stop, size = start[size > 0], stop[size > 0], size[size > 0]
        begins[start] = False
        rest = start + size
        begins[rest[rest < stop]] = True
    starts = at_byte[np.flatnonzero(begins)]
    return starts, np.append(starts[1:], len(data)), np.searchsorted(starts, offsets)
