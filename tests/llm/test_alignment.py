"""Tokenizer alignment against a plain walk over both tokenizations of whole texts."""

import os
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallyspark.llm import _counts, alignment, queries

from .test_llm import DIGEST, SCHEMA, rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "a  b", " lead", "trail ", "  ", " ", "\n", "a \n b", "tab\t x", "a\n b\r\n\r\n  c", "<|endoftext|> is text </s><s><unk> <0x41>", "▁ marks ▁", "x▁y", "日本語 の テキスト", "é ́ café", "it's 'sx we'll 've", " nbsp 　wide",
    "a\x00b \x01 \x1c \x1f\x85 z", "🙂 👩‍👩‍👧 ok", "ﬁ ﬀ ² ½ Ａ", "0123 4567,89", "a" * 300, "word " * 50, "  sep  ", "﻿bom", "x​ y",
]


@pytest.fixture(scope="module")
def table():
    return [*rows(), *((1000 + k, t, "en", "s1", len(t), None, None, None, None) for k, t in enumerate(ODD))]


@pytest.fixture(scope="module")
def docs(spark, table):
    return spark.createDataFrame(table, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def plain():
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {v: k for k, v in alignment._byte_letters().items()}
    back = {v: k for k, v in letters.items()}

    def tokens(text):
        """Each tokenizer's ids with their bytes; none where the bytes are not those of the text."""
        if not text:
            return [], []
        one = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(back[c] for c in t)) for i, t in zip(one.ids, one.tokens)]
        right = [(i, bytes([i - 3]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        want = (" " + text).encode()
        return (left, right) if all(b"".join(x for _, x in side) == want for side in (left, right)) else ([], [])

    return tokens


def aligned(texts, tokens):
    """Per text: links as (a, b) ids, and its groups."""
    for text in texts:
        left, right = tokens(text)
        spans = [[], []]
        for side, out in zip((left, right), spans):
            at = 0
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
        found = [(i, j) for i, s, e in spans[0] for j, s2, e2 in spans[1] if s < e2 and s2 < e] if len(left) < 400 else list(_swept(*spans))
        cuts = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
        groups, start = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= c) for side in spans) if len(left) < 400 else None)
            start = c
        yield len(left), len(right), found, groups


def _swept(left, right):
    j = 0
    for i, s, e in left:
        while right[j][2] <= s:
            j += 1
        k = j
        while k < len(right) and right[k][1] < e:
            yield i, right[k][0]
            k += 1


def test_alignment(docs, table, plain):
    want = list(aligned([r[1] for r in table], plain))
    counts = Counter(x for w in want for x in w[2])
    best = Counter()
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    expected = Counter((r[0], a, b, len(g), len(found), sum(counts[x] == best[x[1]] for x in found), sum(counts[x] for x in found), "" if not g else None if None in g else ";".join(g)) for r, (a, b, found, g) in zip(table, want))
    got = alignment.align(docs, A, B).collect()
    short = {k[0:2] for k in expected if k[-1] is not None}
    assert Counter((*(tuple(r)[:7]), r.groups if (r.doc_id, r.n_a) in short else None) for r in got) == expected
    assert all(r.groups_sha256 == (DIGEST(r.groups) if r.groups else "") for r in got)
    assert sum(len(k[-1] or "") > 100 for k in expected) > 20 and sum(a == 0 for a, *_ in want) >= 4


def test_small_bounds_change_nothing(docs, monkeypatch):
    """Parts forgotten after each batch, partial counts sent on early, shards of few rows."""
    spark = docs.sparkSession
    before = sorted(map(str, alignment.align(docs, A, B).collect()))
    monkeypatch.setattr(alignment, "MAX_PARTS", 10)
    rows_before, parts = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert sorted(map(str, alignment.align(docs.repartition(5), A, B).collect())) == before
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_before)
        spark.conf.set("spark.sql.shuffle.partitions", parts)


def test_empty_and_no_tokens(spark):
    assert alignment.align(spark.createDataFrame([], SCHEMA), A, B).count() == 0
    got = alignment.align(spark.createDataFrame([(1, None), (None, ""), (2, "▁")], "doc_id bigint, text string"), A, B).collect()
    assert sorted((str(r.doc_id), *tuple(r)[1:]) for r in got) == [(i, 0, 0, 0, 0, 0, 0, "", "") for i in ("1", "2", "None")]


def test_text_ids_and_query(spark, tmp_path, table):
    spark.createDataFrame([r[:5] for r in table], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_tokenizer_alignment(spark, str(tmp_path))
    assert got.columns == ["doc_id", *alignment.NUMBERS, "groups_sha256"] and got.count() == len(table)
    assert alignment.align(spark.createDataFrame([("x", "two words")], "doc_id string, text string"), A, B).first().doc_id == "x"


def test_shards(spark):
    rng = np.random.default_rng(3)
    keys = rng.integers(-50, 50, 5000)
    df = spark.createDataFrame([(int(k), int(k) % 3 + 1) for k in keys], "key bigint, n bigint").repartition(6)
    shards = _counts.sorted_shards(df)
    want = Counter()
    for k in keys.tolist():
        want[k] += k % 3 + 1
    asked = np.arange(-60, 60)
    assert shards.open().get(asked).tolist() == [want[k] for k in asked.tolist()]
    assert shards.total == sum(want.values()) and shards.rows.sum() == len(want)
    none = _counts.sorted_shards(df.where("false"))
    assert none.open().get(asked).sum() == 0 and none.total == 0


def test_parts_give_what_whole_texts_do(plain):
    """Every letter that goes to the quicker library, and random mixes of them, against the tokenizers on whole texts."""
    rng, pair = np.random.default_rng(5), alignment.Pair(A, B)
    sure = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and not alignment._UNSURE.match(chr(c))]
    texts = [f"a{c}1 {c}{c} b{c}\n" for c in sure]
    few = ["a", "th", "'s", "'", " ", "  ", "\n", "é", "1", "23", "!", "?#", "ß", "the", "日", " of", "\t", "x", "ing", " "]
    texts += ["".join(rng.choice(few, rng.integers(1, 20))) for _ in range(3000)]
    texts += ["".join(map(chr, rng.integers(97, 123, rng.integers(1, 40)))) for _ in range(3000)]
    for text in texts:
        left, right = plain(text)
        parts = pair.parts(text)
        whole, a, b = pair.encode(parts)
        assert (a.tolist(), b.tolist()) == ([i for i, _ in left], [i for i, _ in right]) or not whole.all() and not left, text
    assert pair.slow is None
