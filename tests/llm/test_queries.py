"""The registered queries and the pipeline's stages on small tables, against plain versions."""

from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import bpe, mixing, pii, quality, queries

from .test_llm import DIGEST, PATTERNS, RANKS, base_spans, levels, metrics, removed, rows, similar, words

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def table():
    return [r[:5] for r in rows()]


@pytest.fixture(scope="module")
def folder(spark, table, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(table, DOCS).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 40, 2)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    said = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "<|im_end|>\n"), (1, 2, "assistant", None), (2, 0, None, "x"), (None, None, "user", ""), (3, 0, "assistant", "same"), (3, 0, "assistant", "same")]
    spark.createDataFrame(said, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return d


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    for name, schema in (("documents", DOCS), ("labels", "doc_id bigint, quality int, toxic int"), ("conversations", "conv_id bigint, turn bigint, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{d}/{name}.parquet")
    return d


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def test_op1(spark, folder, table):
    want = Counter()
    for r in table:
        spans = base_spans(r[1] or "")
        want[(r[0], *(sum(s[0] == k for s in spans) for k in PATTERNS), DIGEST(",".join(f"{k}:{a}:{b}" for k, a, b in spans)))] += 1
    got = queries.op1_pii(spark, folder).collect()
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == want
    assert all(len(r.scores.split(",")) == len(r.spans.split(",")) for r in got)


def test_op4(spark, folder):
    turns = {1: [("user", "hi </s>"), ("assistant", "<|im_end|>\n"), ("assistant", "")], 2: [("", "x")], None: [("user", "")], 3: [("assistant", "same")] * 2, -7: [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]}
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, folder).collect()}
    assert set(got) == set(turns)
    for conv, said in turns.items():
        loss, r = "".join(t for role, t in said if role == "assistant"), got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(said), DIGEST("".join(f"{a}\n{b}\n" for a, b in said)), len(loss), DIGEST(loss))


def test_op3_op5_op7_op9_op10(spark, folder, table, library):
    assert Counter((r.doc_id, r.n_chars) for r in queries.op3_lz_fingerprint(spark, folder).collect()) == Counter((r[0], len(r[1] or "")) for r in table)
    sizes = Counter()
    for r in table:
        sizes[r[3]] += len(words(r[1]))
    goal = levels(dict(sizes), (1, 2, 3), 3)
    got = queries.op5_mixing(spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source").distinct(), "doc_id").collect()
    assert all(any(abs(r.target - t) < 1e-6 for t in goal.values()) and r.taken <= 3 * r.size for r in got)
    assert Counter(tuple(r)[:4] for r in queries.op7_substring_dedup(spark, folder).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == Counter(removed(table, 50))
    got = queries.op9_quality_rules(spark, folder).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == Counter((r[0], *metrics(r[1])) for r in table)
    ids = lambda t: library.encode_ordinary(t or "")
    got = queries.op10_byte_bpe(spark, folder).collect()
    assert Counter(map(tuple, got)) == Counter((r[0], len(ids(r[1])), DIGEST(" ".join(map(str, ids(r[1])))), DIGEST(r[1] or "")) for r in table)


def test_op2_op6_op8_return_a_row_a_document(spark, folder, table):
    ids = Counter(r[0] for r in table)
    for query in (queries.op2_site_quality, queries.op6_token_counts):
        assert Counter(r.doc_id for r in query(spark, folder).collect()) == ids
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in queries.op8_ngram_jaccard_join(spark, folder).collect()) == Counter(similar(table))


def test_empty_tables(spark, nothing):
    for name, query in queries.queries().items():
        assert query(spark, nothing).count() == (1 if name == "op4_chat_format" else 0), name
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_pipeline_stages(spark, folder, table, library):
    docs = spark.createDataFrame([(*r, "x", 1) for r in table], DOCS + ", row string, _key int").repartition(2)  # names that clash
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: Counter(tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect())
    # 1: rows that the operator keeps, by id, text and language.
    kept = quality.judge(docs.select(*corpus_pipeline.COLUMNS)).where("kept").select("row").distinct().collect()
    keys = docs.select(*corpus_pipeline.COLUMNS, F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("und"))).alias("k")).collect()
    want = Counter(tuple(r)[:5] for r in keys if r.k in {x.row for x in kept})
    one = stages["quality rules"](spark, docs, folder)
    assert plain(one) == want and not [r for r in want if metrics(r[1])[-1]]
    # 2: one of each class, with equal texts of several ids, null ids and two texts of one id.
    two = stages["n-gram Jaccard join"](spark, docs, folder)
    classes = {}
    for r, (_, least, _) in zip(table, similar(table)):
        classes.setdefault((least, frozenset(words(r[1])) if least is None else None), []).append(r)
    got = plain(two)
    assert sum(got.values()) == len(set(got)) and all(r in table for r in got)
    named = {least: members for (least, _), members in classes.items() if least is not None}
    texts = {m[1] for members in named.values() for m in members}
    assert {r[0] for r in got} >= set(named) and len([r for r in got if r[1] in texts]) >= len(named)
    # 3: texts redacted as the operator does; null stays null.
    three = stages["PII"](spark, docs, folder)
    redacted = [(r[0], pii.redact(r[1], pii.find_spans(r[1]), base=True) if r[1] is not None else None) for r in table]
    assert Counter((r.doc_id, r.text, r.n_chars) for r in three.collect()) == Counter((i, t, None if t is None else len(t)) for i, t in redacted)
    # 4: each row as often as the mix takes it.
    four = stages["mixing sources to target weights"](spark, docs, folder)
    times = {(r.doc_id, r.row_hash): r.copies for r in mixing.mix(docs).collect()}
    hashed = docs.select(*corpus_pipeline.COLUMNS, mixing.row_hash("doc_id", "text").alias("h")).collect()
    want = Counter()
    for r in hashed:
        want[tuple(r)[:5]] += times[r.doc_id, r.h]
    assert plain(four) == +want
    # 5 and all together.
    five = stages["byte-level BPE encoding and decoding"](spark, docs, folder)
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in five.collect()) == Counter((r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in table)
    steps = spark.createDataFrame(table, DOCS)
    for _, stage in corpus_pipeline.STAGES:
        steps = stage(spark, steps, folder)
    key = lambda df: Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in df.collect())
    whole = key(corpus_pipeline.run(spark, folder))
    assert whole == key(steps) and sum(whole.values()) > 20


def test_pipeline_masks_what_its_context_speaks_against(spark):
    said = ["Order id 7781, reach me under +49 30 1234 5678 today", "version 10.0.0.1 of the tool", "no data here", "id 4111 1111 1111 1111"]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(said)], DOCS)
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["PII"](spark, docs, "").collect()}
    assert got == {0: "Order id 7781, reach me under [PHONE] today", 1: "version [IP] of the tool", 2: said[2], 3: "id [CARD]"}
