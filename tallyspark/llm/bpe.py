"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

The ranked vocabulary is compiled to a trie of tokens. Two neighbouring tokens can stand in an encoding exactly if merging
their joined bytes by rank gives those two again, and a sequence is the encoding of its bytes exactly if all its neighbours
can. So the encoding of each prefix of a piece ends in one determined token, which the transducer finds from the places at
which a token may still grow: for each of them the trie node reached and the token that ends there. Such a set is one state
of the determinised transducer; states and arcs are made when first met. A token is certain as soon as the ways back from
all these places pass it: the lookahead is bounded by the longest token. Work is linear in the bytes, for pieces of any
length.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._pieces import PATTERN, split
from ._tables import enter, id_text, small_batches
from ._words import BASE_BYTES, CHUNK, buffers, byte_codes, inverse, powers

#: Arcs of one transducer, known neighbours, and pieces of one generation of a cache kept in a Python worker; beyond that they
#: are dropped and made anew. A worker outlives its task, so these bound what it holds while later stages run.
MAX_ARCS, MAX_PAIRS, MAX_PIECES = 600_000, 400_000, 300_000
#: Bytes after which a long piece's certain tokens are let go, and of the longest piece that is kept: with their number that bounds the cache.
HELD, KEPT = 1024, 64


def read_ranks(path: str) -> dict[bytes, int]:
    """The vocabulary file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def merge_by_rank(data: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The plain definition: merge the neighbouring pair of lowest rank, the leftmost of equals, until none is in the vocabulary. For short strings."""
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, len(ranks) + 1), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank > len(ranks):
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return [ranks[p] for p in parts]


class State(dict):
    """One state: arcs by byte to the next one; places (trie node and token before, in turn) a token may grow from, and the token that ends what was read."""

    __slots__ = ("places", "token")


class Transducer:
    """Encodes a piece; tokens leave when no later byte can change them, at least every HELD bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens: dict[int, bytes] = {rank: token for token, rank in ranks.items()}
        self.sizes = [len(self.tokens.get(i, b"")) for i in range(max(self.tokens) + 1)]
        self.kids: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        self.depth: list[int] = [0]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                if byte not in self.kids[node]:
                    self.kids[node][byte] = len(self.kids)
                    self.kids.append({})
                    self.ends.append(-1)
                    self.depth.append(self.depth[node] + 1)
                node = self.kids[node][byte]
            self.ends[node] = rank
        self.can: dict[int, bool] = {}
        self.states: dict[tuple[int, ...], State] = {}
        self._reset()

    def forget(self) -> None:
        for state in self.states.values():  # states point at each other: without their arcs they go at once
            state.clear()
        self.states = {}

    def _reset(self) -> None:
        self.forget()
        self.n_arcs = 0
        self.start = self._state((0, -1), -1)

    def _state(self, places: tuple[int, ...], token: int) -> State:
        state = self.states.get(places)
        if state is None:
            self.states[places] = state = State()
            state.places, state.token = places, token
        return state

    def fits(self, left: int, right: int) -> bool:
        """Whether right may follow left; left -1 is the beginning."""
        key = (left + 1) << 24 | right
        known = self.can.get(key)
        if known is None:
            if left < 0:
                known = merge_by_rank(self.tokens[right], self.ranks) == [right]
            else:
                known = self.fits(-1, right) and merge_by_rank(self.tokens[left] + self.tokens[right], self.ranks) == [left, right]
            if len(self.can) >= MAX_PAIRS:
                self.can.clear()
            self.can[key] = known
        return known

    def _arc(self, state: State, byte: int) -> State:
        """The state after a byte, made on first use. Places are node and token before, one after another."""
        kids, ends, can, found, grown = self.kids, self.ends, self.can, -1, []
        old = iter(state.places)
        for node, last in zip(old, old):
            kid = kids[node].get(byte)
            if kid is None:
                continue
            if found < 0:
                token = ends[kid]
                if token >= 0:
                    fits = can.get((last + 1) << 24 | token)
                    if self.fits(last, token) if fits is None else fits:
                        found = token
            if kids[kid]:
                grown += (kid, last)
        grown += (0, found)  # from the root, after the token that ends here
        places = tuple(grown)
        step = self.states.get(places)
        if step is None:
            step = self._state(places, found)
        state[byte] = step
        self.n_arcs += 1
        return step

    def _back(self, ends: list[State], at: int) -> list[int]:
        """The tokens up to a place, from the states at each place."""
        out, sizes = [], self.sizes
        while at:
            token = ends[at - 1].token
            out.append(token)
            at -= sizes[token]
        return out[::-1]

    def encode(self, piece: bytes) -> tuple[int, ...]:
        if (whole := self.ranks.get(piece)) is not None:
            return (whole,)
        state, done, ends = self.start, [], []
        for begin in range(0, len(piece), HELD):
            if self.n_arcs > MAX_ARCS:  # one long piece may make any number: go on from the same places in an empty machine
                places, token = state.places, state.token
                self._reset()
                state = self._state(places, token)
            if begin:  # what all ways back agree on is certain
                ways = [self._back(ends, len(ends) - self.depth[node]) for node in state.places[::2]]
                agreed = 0
                for column in zip(*ways):
                    if len(set(column)) > 1:
                        break
                    agreed += 1
                done += ways[0][:agreed]
                ends = ends[sum(self.sizes[t] for t in ways[0][:agreed]) :]
            for byte in piece[begin : begin + HELD] if begin or len(piece) > HELD else piece:
                state = state[byte] if byte in state else self._arc(state, byte)
                ends.append(state)
        return (*done, *self._back(ends, len(ends)))


class Utf8Stream:
    """Incremental UTF-8: feed() returns the characters completed so far and keeps an unfinished one for the next call."""

    #: First byte's range, bytes that follow it, and range of the first of those. Fixed values of the UTF-8 format.
    LEADS = ((0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF), (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F))

    def __init__(self) -> None:
        self.held = b""

    @classmethod
    def waiting(cls, data: bytes) -> int:
        """How many bytes at the end are the beginning of a character that later bytes may complete."""
        for back in range(1, min(3, len(data)) + 1):
            first = data[-back]
            if first & 0xC0 == 0x80:
                continue
            for low, high, more, least, most in cls.LEADS:
                if low <= first <= high:
                    return back if back <= more and (back == 1 or least <= data[1 - back] <= most) else 0
            return 0
        return 0

    def feed(self, data: bytes) -> str:
        data = self.held + data
        keep = self.waiting(data)
        self.held = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")

    def close(self) -> str:
        rest, self.held = self.held, b""
        return rest.decode("utf-8", "replace")


class Recent(dict):
    """A bounded cache of two generations: when the newer is full it becomes the older, from which what is asked for comes back."""

    def __init__(self) -> None:
        super().__init__()
        self.older: dict[bytes, tuple[int, ...]] = {}

    def turn(self) -> None:
        if len(self) > MAX_PIECES:
            self.older = dict(self)
            self.clear()


class Codec:
    """Encoding and decoding of whole texts; one for each Python worker."""

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.machine = Transducer(self.ranks)
        self.find = regex.compile(pattern).findall
        self.usual = pattern == PATTERN
        self.pieces = Recent()
        top = max(self.ranks.values()) + 1
        self.decimal = [str(i) for i in range(top)]
        self.bytes = [self.machine.tokens.get(i, b"") for i in range(top)]

    def _known(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        known = self.pieces
        known.turn()
        out = list(map(known.get, pieces))
        if None in out:
            older, encode = known.older.get, self.machine.encode
            for at, ids in enumerate(out):
                if ids is None:
                    piece = pieces[at]
                    out[at] = known.get(piece) or older(piece) or encode(piece)
                    if len(piece) <= KEPT:
                        known[piece] = out[at]
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of a text, each piece of the pattern by itself."""
        return list(chain.from_iterable(self._known([p.encode() for p in self.find(text)])))

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text. Under the usual pattern, the different pieces of about CHUNK bytes of texts are encoded once, and their ids put together by place."""
        if not self.usual:
            for text in texts:
                yield np.array(self.encode(text.as_py()), np.int32)
            return
        data, offsets = buffers(texts)
        first = 0
        while first < len(texts):
            last = min(len(texts), max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, "right")) - 1))
            yield from self._encode_chunk(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last

    def _encode_chunk(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        starts, ends, bounds = split(data, offsets)
        if not len(starts):
            yield from (np.zeros(0, np.int32) for _ in bounds[1:])
            return
        prefix = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(byte_codes(data) * powers(BASE_BYTES, len(data))[: len(data)], out=prefix[1:])
        hashes = (prefix[ends] - prefix[starts]) * powers(inverse(BASE_BYTES), len(data))[starts]
        _, one, kind = np.unique(hashes, return_index=True, return_inverse=True)
        raw = data.tobytes()
        ids = self._known([raw[a:b] for a, b in zip(starts[one].tolist(), ends[one].tolist())])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat, begin = np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum())), np.cumsum(sizes) - sizes
        each = sizes[kind]
        where = np.cumsum(each) - each
        out = flat[np.repeat(begin[kind] - where, each) + np.arange(int(each.sum()))]
        where = np.append(where, len(out))
        for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
            mine = out[where[a] : where[b]]
            if b"".join(map(self.bytes.__getitem__, mine.tolist())) == raw[offsets[i] : offsets[i + 1]]:
                yield mine
            else:  # two pieces of one hash
                yield np.array(self.encode(raw[offsets[i] : offsets[i + 1]].decode()), np.int32)

    def decode(self, ids: Iterable[int], step: int = 4096) -> Iterator[str]:
        """The text in parts: ids are taken step by step, as from a stream."""
        ids, stream = list(ids), Utf8Stream()
        for at in range(0, len(ids), step):
            yield stream.feed(b"".join(map(self.bytes.__getitem__, ids[at : at + step])))
        yield stream.close()


_codecs: list[Codec] = []


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    _codecs.append(Codec(path, pattern))
    return _codecs[-1]


def _forget() -> None:
    """Drop what codec() keeps; states point at each other, so their arcs go first."""
    for own in _codecs:
        own.machine.forget()
    _codecs.clear()
    codec.cache_clear()


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, token_ids (if ids), ids_sha256, decoded_sha256 for each row of docs.

    Narrow: no shuffle. A null text counts as empty (no tokens; digests of the empty string), a null id stays null,
    repeated rows give repeated results, an empty table an empty result; other columns of docs are not read. ranks_path
    must be readable on every executor; nothing of the vocabulary passes through the driver.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe", _forget)
        own = codec(ranks_path, pattern)
        for batch in batches:
            rows: dict[str, list] = {"n": [], "ids": [], "sha": [], "back": []}
            for found in own.encode_all(batch.column(1)):
                plain = found.tolist()
                digest = hashlib.sha256()
                for part in own.decode(plain):
                    digest.update(part.encode())
                rows["n"].append(len(plain))
                rows["ids"].append(found if ids else None)
                rows["sha"].append(hashlib.sha256(" ".join(map(own.decimal.__getitem__, plain)).encode()).hexdigest())
                rows["back"].append(digest.hexdigest())
            out = {"doc_id": batch.column(0), "n_tokens": pa.array(rows["n"], pa.int64())}
            if ids:
                out["token_ids"] = pa.array(rows["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out | {"ids_sha256": pa.array(rows["sha"], pa.string()), "decoded_sha256": pa.array(rows["back"], pa.string())})

    kind = docs.schema[id_col].dataType.simpleString()
    return id_text(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, {'token_ids array<int>, ' if ids else ''}ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id and text of rows of token ids; null ids give the empty text, bytes that are not UTF-8 the replacement character."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("bpe", _forget)
        own = codec(ranks_path, pattern)
        for batch in batches:
            texts = ["".join(own.decode(x.as_py() or ())) for x in batch.column(1)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {encoded.schema[id_col].dataType.simpleString()}, text string")
