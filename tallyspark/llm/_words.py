"""Vectorised words and window hashes of a batch of texts.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. Each word gets a
64-bit polynomial hash of its bytes, and each window of words a polynomial hash of its words' hashes; both are finished by
a mixing step. All work is numpy over whole batches; texts are cut into groups of about CHUNK bytes so that memory is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 19
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_powers: dict[tuple[int, int], np.ndarray] = {}
BASE_BYTES, BASE_WORDS, BASE_CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64, kept for the next call."""
    key = (base, max(1 << 16, 1 << int(n + 1).bit_length()))
    if key not in _powers:
        for old in [k for k in _powers if k[0] == base and k[1] < key[1]]:
            del _powers[old]
        held = [k for k in _powers if k[0] == base]
        if held:
            return _powers[held[0]]
        p = np.full(key[1], base, np.uint64)
        p[0] = 1
        _powers[key] = np.multiply.accumulate(p)
    return _powers[key]


def byte_codes(data: np.ndarray) -> np.ndarray:
    """A random odd number for each byte."""
    return _BYTE[data]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A fixed bijection that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: byte offsets in data, the hash of each, and for text i its words bounds[i] to bounds[i + 1]."""

    __slots__ = ("bounds", "data", "ends", "hashes", "offsets", "starts")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        solid = ~_SPACE[data]
        before = np.empty_like(solid)
        before[:1] = False
        before[1:] = solid[:-1]
        inner = offsets[1:-1][offsets[1:-1] < len(data)]
        before[inner] = False
        self.starts = np.flatnonzero(solid & ~before)
        after = np.empty_like(solid)
        after[-1:] = False
        after[:-1] = solid[1:]
        after[inner[inner > 0] - 1] = False
        self.ends = np.flatnonzero(solid & ~after) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * powers(BASE_BYTES, len(data))[: len(data)], out=prefix[1:])
        back = powers(inverse(BASE_BYTES), len(data))
        self.hashes = mix((prefix[self.ends] - prefix[self.starts]) * back[self.starts])

    def windows(self, n: int, base: int = BASE_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """The hash of the n words from each word on, and whether those are within one text."""
        total = len(self.hashes)
        hashes, whole = np.zeros(total, np.uint64), np.zeros(total, bool)
        if total >= n:
            prefix = np.zeros(total + 1, np.uint64)
            np.cumsum(self.hashes * powers(base, total)[:total], out=prefix[1:])
            hashes[: total - n + 1] = mix((prefix[n:] - prefix[: total - n + 1]) * powers(inverse(base), total)[: total - n + 1])
            text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
            whole[: total - n + 1] = text[: total - n + 1] == text[n - 1 :]
        return hashes, whole


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and where each text begins; the last offset is the end."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()) if texts.null_count == 0 else texts.cast(pa.large_binary()).fill_null(b"")
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def groups(texts: pa.Array, chunk: int = CHUNK) -> Iterator[tuple[int, int, Words]]:
    """The texts in groups of about chunk bytes, at least one text each: first row, row after the last, their words."""
    if not len(texts):
        return
    data, offsets = buffers(texts)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk, "right")) - 1)
        last = min(last, len(texts))
        yield first, last, Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
