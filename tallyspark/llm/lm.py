"""Scoring texts by a language model that learns from part of the documents.

Every word of every training document is counted: hashed to 64 bits, summed in tasks, and kept in sorted memory-mapped
shards. The self-attention model of `attention` is trained in the tasks on all training documents: each is learnt from in one
round, in which every trainer goes on from the same weights over its own texts, and the weights are averaged. Texts of later rounds are
scored before they are learnt from: that finds how much of a word's probability should come from the word counts, each word's own occurrence left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from ._counts import COUNT_ROWS, Partial, Shards, sorted_shards
from ._tables import cut, enter, id_text, small_batches, some_texts, spent
from .attention import RATE, STEP_BLOCKS, Classes, Model, blocks

#: Documents with crc32(id) modulo FOLDS equal to HELD are not learnt from.
FOLDS, HELD = 7, 2
#: One training document in so many trains the attention model (1: all); rounds; bytes of text for a trainer; steps a trainer
#: makes in a round at least, unless that were more passes over its texts.
SHARE, ROUNDS, TRAINER_BYTES, LEAST_STEPS, PASSES = 1, 3, 32 << 20, 100, 12
#: Blocks in a step where a trainer has at least LEAST_STEPS such steps in a round: they take less time a token.
WIDE_STEP = 512
#: Words kept in a worker, and bytes of them; different words counted in a task before they are sent on.
MAX_WORDS, MAX_WORD_BYTES, COUNTED = 400_000, 16 << 20, 600_000
#: Shares of the word counts in a word's probability that are tried.
GATES = (0.0, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.999)
#: Bytes of words that may not stand between others: controls, and those of white space beyond ASCII.
_ODD = re.compile(rb"[\x00-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2[\x80\x81]|\xe3\x80\x80")
_held: dict[str, Subwords] = {}


class Subwords:
    """A byte-level vocabulary: ids of words, each with a space before it. end: the id that no token has."""

    def __init__(self, path: str):
        import tiktoken

        from ._pieces import PATTERN

        ranks = bpe.read_ranks(path)
        self.end = max(ranks.values(), default=-1) + 1
        self.names = [b""] * (self.end + 1)
        for token, k in ranks.items():
            self.names[k] = token
        self.library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        self.opens = np.array([x[:1] == b" " for x in self.names], bool)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some words, one behind the other, and how many each has.

        Words of usual letters are joined by spaces and parted again at the ids that begin with one; others might hold what counts as white space elsewhere, and are taken alone.
        """
        plain = [k for k, w in enumerate(words) if not _ODD.search(w)]
        ids = np.array(self.library.encode_ordinary(" " + b" ".join([words[k] for k in plain]).decode()) if plain else [], np.int32)
        if len(plain) == len(words):
            return ids, np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        size = np.zeros(len(words), np.int64)
        size[plain] = np.diff(np.append(np.flatnonzero(self.opens[ids]), len(ids)))
        rest = {k: self.library.encode_ordinary(" " + words[k].decode()) for k in np.flatnonzero(size == 0).tolist()}
        for k, own in rest.items():
            size[k] = len(own)
        out, start = np.zeros(int(size.sum()), np.int32), np.cumsum(size) - size
        usual = np.zeros(len(words), bool)
        usual[plain] = True
        out[np.repeat(usual, size)] = ids
        for k, own in rest.items():
            out[start[k] : start[k] + len(own)] = own
        return out, size


def _subwords(path: str) -> Subwords:
    if path not in _held:
        _held.clear()
        _held[path] = Subwords(path)
    return _held[path]


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lowered."""
    return text.encode().lower().split() if text else []


def word_keys(some: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(w) for w in some], np.uint64).view(np.int64)


class Lexicon:
    """Words met by a worker, with their subword ids and corpus counts; row 0 is the end of a text. Emptied when full."""

    def __init__(self, subwords: Subwords, shards: Shards | None, n_ends: int):
        self.subwords, self.n_ends = subwords, n_ends
        self.lookup = shards.open() if shards else None
        self.clear()

    def clear(self) -> None:
        self.at: dict[bytes, int] = {}
        self.bytes = 0
        self.ids = np.array([self.subwords.end], np.int32)
        self.start, self.size = np.zeros(1, np.int64), np.ones(1, np.int64)
        self.count = np.array([self.n_ends], np.int64)

    def rows(self, some: list[bytes]) -> np.ndarray:
        if len(self.at) > MAX_WORDS or self.bytes > MAX_WORD_BYTES:
            self.clear()
        found = np.fromiter(map(self.at.get, some, repeat(-1)), np.int64, len(some))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys(some[k] for k in missing))
            base = len(self.size)
            self.at.update(zip(new, range(base, base + len(new))))
            self.bytes += sum(map(len, new))
            ids, size = self.subwords.encode(new)
            self.start = np.append(self.start, len(self.ids) + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self.ids = np.append(self.ids, ids)
            count = np.zeros(len(new), np.int64)
            if self.lookup:
                own, back = np.unique(word_keys(new), return_inverse=True)
                count = self.lookup.get(own)[back]
            self.count = np.append(self.count, count)
            found[missing] = [self.at[some[k]] for k in missing]
        return found

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all tokens of some texts (words, then one end), and the first of each text."""
        each = [words(t) for t in texts]
        sizes = np.array(list(map(len, each)), np.int64)
        rows = self.rows(list(chain.from_iterable(each)))
        first = np.cumsum(sizes + 1) - sizes - 1
        out = np.zeros(len(rows) + len(each), np.int64)
        inner = np.ones(len(out), bool)
        inner[first + sizes] = False
        out[inner] = rows
        return out, first

    def subword_ids(self, rows: np.ndarray) -> np.ndarray:
        size = self.size[rows]
        return self.ids[np.arange(int(size.sum())) + np.repeat(self.start[rows] - (np.cumsum(size) - size), size)]


def token_scores(model: Model, classes: Classes, lexicon: Lexicon, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each token (word or end) the natural logarithm of what the attention model gives its subwords."""
    size = lexicon.size[rows]
    ids = lexicon.subword_ids(rows)
    context, begins, goal, place = blocks(ids, np.add.reduceat(size, first), lexicon.subwords.end, classes)
    each = model.score(context, begins, goal).ravel()[place].astype(np.float64) + classes.share[ids]
    return np.add.reduceat(each, np.cumsum(size) - size)


def is_held_out(id_col: str = "doc_id") -> Column:
    """A null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD


def gather(docs: DataFrame, ranks: str) -> tuple[Shards, np.ndarray, int]:
    """Of all training documents: the shards of word counts, the count of each subword id, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lm", _held.clear)
        subwords, total, texts, partial = _subwords(ranks), Counter(), 0, Partial()
        seen = np.zeros(subwords.end + 1, np.int64)

        def flush() -> None:
            some, n = list(total), np.fromiter(total.values(), np.int64, len(total))
            total.clear()
            partial.add(word_keys(some), n)
            ids, size = subwords.encode(some)
            seen[:] += np.bincount(ids, np.repeat(n, size), len(seen)).astype(np.int64)

        def out(kind: int, keys: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(keys), COUNT_ROWS):
                own = keys[k : k + COUNT_ROWS]
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(own), kind, np.int32)), "key": pa.array(own), "n": pa.array(n[k : k + COUNT_ROWS])})

        for _, some in some_texts(batches):
            for text in some:
                total.update(words(text))
            texts += len(some)
            if len(total) > COUNTED:
                flush()
                if partial.full():
                    yield from out(0, *partial.take())
        if texts:
            flush()
            seen[subwords.end] = texts
            used = np.flatnonzero(seen)
            yield from out(0, *partial.take())
            yield from out(1, used, seen[used])

    found = cut(docs.mapInArrow(run, "kind int, key bigint, n bigint"))
    shards = sorted_shards(found.where("kind = 0").select("key", "n"), written=True)
    counts = np.zeros(_subwords(ranks).end + 1, np.int64)
    for k, n in found.where("kind = 1").groupBy("key").agg(F.sum("n")).collect():  # a row for each id of the vocabulary at most
        counts[k] = n
    spent(found)
    return shards, counts, int(counts[-1])


def dealt(rows: DataFrame, trainers: int) -> DataFrame:
    """Each trainer's rows in a partition of their own: by a hash of their numbers several would share one, which would train them one after another while other tasks wait."""
    return rows.repartitionById(trainers, F.col("trainer").cast("int"))


def train(sample: DataFrame, ranks: str, classes: Classes, shards: Shards, n_docs: int) -> tuple[Model, float]:
    """The model after ROUNDS rounds over the sample (trainer, round, text), a written table in which each trainer's texts lie together; and the share of the word counts.

    In a round a trainer takes its texts of the round, and passes over them more often if that makes fewer than LEAST_STEPS steps. The
    weights of a round's trainers are averaged by their blocks: in tasks first, then the sums of about as many groups as their number's root.
    The share is the one of GATES under which the texts of all rounds but the first are most probable by the weights that have not learnt from them,
    if each word's own occurrence does not count; the greatest where there are none.
    """
    model, sums = Model.fresh(classes), np.zeros(len(GATES))
    trainers = 1 + (sample.agg(F.max("trainer")).first()[0] or 0)
    total = shards.total + n_docs

    def rounds(weights: np.ndarray, k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            enter("lm", _held.clear)
            lexicon, before = Lexicon(_subwords(ranks), shards if k else None, n_docs), Model(weights)

            def learnt(who: int, held: list, sums: np.ndarray) -> pa.RecordBatch:
                context, begins, goal = (np.concatenate(x) for x in zip(*held))
                own = Model(weights.copy())
                width = WIDE_STEP if len(context) >= WIDE_STEP * LEAST_STEPS else STEP_BLOCKS
                once = -(-len(context) // width)  # steps of a pass
                own.train(context, begins, goal, max(once, min(4 * LEAST_STEPS, PASSES * once) if width == STEP_BLOCKS else 0), RATE * (1 - k / ROUNDS), who * ROUNDS + k, width)
                return pa.RecordBatch.from_pydict({"n": pa.array([len(context)], pa.int64()), "weights": pa.array([own.weights.astype(np.float64).tobytes()], pa.binary()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

            now, held, sums = None, [], np.zeros(len(GATES))
            for who, texts in some_texts(batches):
                who = who.to_pylist()
                for t in dict.fromkeys(who):
                    if t != now and held:
                        yield learnt(now, held, sums)
                        held, sums = [], np.zeros(len(GATES))
                    now = t
                    rows, first = lexicon.texts([x for w, x in zip(who, texts) if w == t])
                    size, ids = lexicon.size[rows], lexicon.subword_ids(rows)
                    context, begins, goal, place = blocks(ids, np.add.reduceat(size, first), lexicon.subwords.end, classes)
                    if k:
                        each = before.score(context, begins, goal).ravel()[place].astype(np.float64) + classes.share[ids]
                        scores = np.add.reduceat(each, np.cumsum(size) - size)
                        sums += [mixed(gate, lexicon.count[rows] - 1, max(1, total - 1), scores).sum() for gate in GATES]
                    asked = np.full(goal.size, -1, np.int16)
                    asked[place] = goal.ravel()[place]
                    held.append((context, begins, asked.reshape(goal.shape)))
            if held:
                yield learnt(now, held, sums)

        return run

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks_, sums = None, 0, np.zeros(len(GATES))
        for batch in batches:
            for n, raw, more in zip(*(batch.column(i).to_pylist() for i in range(3))):
                own = np.frombuffer(raw) * n
                total, blocks_, sums = own if total is None else total + own, blocks_ + n, sums + more
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": pa.array([blocks_], pa.int64()), "weights": pa.array([(total / blocks_).tobytes()], pa.binary()), "sums": pa.array([sums.tolist()], pa.list_(pa.float64()))})

    schema = "n bigint, weights binary, sums array<double>"
    for k in range(ROUNDS):
        each = sample.where(F.col("round") == k).select("trainer", "text").mapInArrow(rounds(model.weights, k), schema)
        parts = each.repartition(math.isqrt(trainers - 1) + 1).mapInArrow(average, schema).collect()
        if parts:
            blocks_ = sum(r["n"] for r in parts)
            model = Model(sum(np.frombuffer(r["weights"]) * (r["n"] / blocks_) for r in parts).astype(np.float32))
            sums = sums + np.sum([r["sums"] for r in parts], 0)
    return model, GATES[int(np.argmax(sums))] if sums[0] else GATES[-1]


def mixed(gate: float, count: np.ndarray, total: int, scores: np.ndarray, rows: np.ndarray | None = None) -> np.ndarray:
    """log(gate * count / total + (1 - gate) * exp(scores)); count[rows] if rows are given."""
    if not gate or not total:
        return scores
    with np.errstate(divide="ignore"):
        share = math.log(gate) + np.log(count / total)
    return np.logaddexp(share if rows is None else share[rows], math.log1p(-gate) + scores)


def score_documents(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, held_out, n_tokens, n_known (occurring in training texts), train_tokens, base_score (of add-one
    word shares), score (of the model), as decimal logarithms of the text's probability.

    Tokens are words, A-Z lowered, and an end. ranks: a byte-level vocabulary, readable where tasks and the driver run. Null
    texts are empty, a null id counts as an empty one; repeated rows are learnt from and come back as often as they are there;
    with nothing to learn from all shares are even; an empty table gives no row; other columns are not read. Scores are
    rounded to three places, as sums of 32-bit products differ beyond with the rows that come together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = id_text(docs, id_col, text_col)
    learnt = texts.where(~is_held_out())
    shards, counts, n_docs = gather(learnt, ranks)
    classes = Classes.of(counts, _subwords(ranks).names)
    drawn = F.xxhash64(F.col("doc_id").cast("string"), "text")
    some = learnt.where(F.pmod(drawn, F.lit(SHARE)) == 0)
    size = some.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    trainers = 1 + size // TRAINER_BYTES
    taken = F.pmod(F.shiftright(drawn, 8), F.lit(trainers)).alias("trainer"), F.pmod(F.shiftright(drawn, 40), F.lit(ROUNDS)).alias("round")
    sample = cut(dealt(some.select(*taken, drawn.alias("drawn"), "text"), trainers).sortWithinPartitions("trainer", "round", "drawn"))
    model, gate = train(sample, ranks, classes, shards, n_docs)
    spent(sample)
    total, kinds = shards.total + n_docs, int(shards.rows.sum()) + (n_docs > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("lm", _held.clear)
        lexicon = Lexicon(_subwords(ranks), shards, n_docs)
        for ids, own in some_texts(batches):
            rows, first = lexicon.texts(own)
            known = lexicon.count > 0
            scores = mixed(gate, lexicon.count, total, token_scores(model, classes, lexicon, rows, first), rows) / math.log(10)
            base = np.log10((lexicon.count + 1) / (total + kinds + 1))[rows]
            per = lambda x: np.add.reduceat(x, first)
            yield pa.RecordBatch.from_pydict({"doc_id": ids, "n_tokens": pa.array(per(np.ones(len(rows), np.int64))), "n_known": pa.array(per(known[rows].astype(np.int64))), "train_tokens": pa.array(np.full(len(own), total, np.int64)), "base_score": pa.array(per(base)), "score": pa.array(np.round(per(scores), 3))})

    kind = docs.schema[id_col].dataType.simpleString()
    scored = texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
