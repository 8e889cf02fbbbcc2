"""The registered queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, chat, chosenpath, lm, lz, mixing, pii, quality, site_quality, spelling, substrings, unigram
from ._tables import table, table_if_there

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _span_text(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"), redacted=False)
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"].isin(*pii.BASE_KINDS))
    return found.select("doc_id", *(of(k).alias(f"n_{k}") for k in pii.BASE_KINDS), F.sha2(_span_text(base), 256).alias("base_sha256"), _span_text(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda x: F.round(x["score"], 2).cast("string")), ",").alias("scores"), *(of(k).alias(f"n_{k}") for k in pii.KINDS[4:]))


def op2_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def op3_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lz.fingerprint_documents(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    own = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    turns = turns.unionByName(own)
    done = chat.format_chat(turns, chat.text_part(F.col("text")))
    said = F.array_join(F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    return done.select(
        "conv_id", F.size(chat.read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"), F.sha2(learnt, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
        "n_parts", F.size("attachments").cast("long").alias("n_attachments"), "expanded_tokens",
    )


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "shards", "shuffle_key")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), length=50).drop("kept_text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.similar_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), labels=table_if_there(spark, sf_dir, "labels"), once=True).drop("row")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, ids=False)


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), groups=False)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), RANKS)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_site_quality, op3_lz_fingerprint, op4_chat_format, op5_mixing, op6_token_counts, op7_substring_dedup, op8_ngram_jaccard_join, op9_quality_rules, op10_byte_bpe, op11_tokenizer_alignment, op12_lm_scoring, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {}
