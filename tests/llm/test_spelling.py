"""Spelling variants against a comparison of all words with all."""

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import queries, spelling

from .test_llm import SCHEMA, rows

UPPER = {c: c + 32 for c in range(65, 91)}


def counted(table):
    total = Counter()
    for doc, text in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            total[run] += 1
    return {w: n for w, n in total.items() if len(w) >= 6 and n >= 5}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v), default=None) for w in words}
    form = {w: v if v is not None and words[v] >= 5 * words[w] else None for w, v in best.items()}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]]


def made():
    """Variants of a few words, among them chains of forms, letters beyond ASCII, long words and words of repeated letters."""
    rng = random.Random(11)
    base = ["monitor", "aaaaaaa", "élévation", "ÀÿÖ×÷ßabc", "committee", "x" * 90 + "y" * 30, "banana", "ananas"]
    words = Counter()
    for w in base:
        words[w] += 400
        for _ in range(25):
            v, n = w, 80
            for _ in range(3):  # a variant of a variant, rarer each time
                k = rng.randrange(len(v))
                v = rng.choice([v[:k] + v[k + 1 :], v[:k] + rng.choice("abé") + v[k:], v[:k] + rng.choice("abxy") + v[k + 1 :]])
                words[v] += n
                n = max(5, n // 5)
    said = [w for w, n in words.items() for _ in range(n)]
    rng.shuffle(said)
    docs = [(k, " ".join(said[k::40])) for k in range(40)]
    return [*docs, (None, docs[3][1]), (5, docs[5][1]), (7, None), (8, ""), (9, "1+2 日本 İstanbul İstanbul K" * 9), (10, "COMMITTEE,committee\ncommit_tee " * 30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), "doc_id bigint, text string").selectExpr("*", "1 AS word", "2 AS n", "'k' AS key", "0 AS part").repartition(3)


def test_variants(docs):
    words = counted(made())
    want = Counter(grouped(words))
    assert Counter(map(tuple, spelling.group_variants(docs).collect())) == want
    assert len(words) > 150 and sum(w[2] not in (w[0], w[1]) for w in want) > 5 and sum(w[4] == 0 for w in want) > 0


def test_split_shards_change_nothing(docs, monkeypatch):
    """Automata of four words, pairs compared by sevens, counts sent on early: the same words with the same neighbours."""
    monkeypatch.setattr(spelling, "SHARD", 4)
    monkeypatch.setattr(spelling, "AT_ONCE", 7)
    monkeypatch.setattr(spelling, "MAX_WORDS", 3)
    assert Counter(map(tuple, spelling.group_variants(docs).collect())) == Counter(grouped(counted(made())))


@given(st.lists(st.text(alphabet="abÿ", min_size=6, max_size=9), unique=True, min_size=1, max_size=40))
@settings(max_examples=80, deadline=None)
def test_a_shard_finds_every_near_word_once(words):
    coded = [w.encode("latin-1") for w in words]
    both = [False] * len(words) + [True] * len(words)
    shard = spelling.Shard(coded * 2, list(range(len(words))) * 2, both)
    count, _ = shard.near(coded * 2, both)
    assert [count[k] + count[k + len(words)] for k in range(len(words))] == [sum(one_apart(a, b) for b in words) for a in words]


def test_empty_and_query(spark, tmp_path):
    assert spelling.group_variants(spark.createDataFrame([], SCHEMA)).count() == 0
    table = [r[:5] for r in rows()]
    spark.createDataFrame(table, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert Counter(map(tuple, got.collect())) == Counter(grouped(counted([r[:2] for r in table])))
