"""The corpus pipeline: quality rules, near-duplicate removal, personal data, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on every row of docs and calls one operator; its result is written as Parquet
and read again as the next one's docs. All but the last return the columns of documents. Null ids are ids like others, null
texts count as empty, null languages and sources are groups of their own, repeated rows are rows (but near-duplicate removal
keeps one), an empty table goes through as one, and columns beyond those of documents are left behind.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chosenpath, mixing, pii, quality
from tallyspark.llm._tables import Scratch, checkpoint_dir, delete, table_if_there

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or their language's perplexity band reject go; the band is drawn from labelled documents where sf_dir has labels. Equal rows are judged alike; a null text is an empty one and goes."""
    good = quality.judge(docs, labels=table_if_there(spark, sf_dir, "labels"), once=True).where("kept").select("row").distinct()
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit("und")))
    return docs.withColumn("row", key).join(good, "row", "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similarity, the one of least id stays; of repeated rows, one. Rows go by id and text, so a null or repeated id loses no other text."""
    return chosenpath.one_of_each_class(docs).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in each text is replaced by its kind in brackets; n_chars follows. Every confirmed mail, ip, card and phone goes, also one whose context speaks against it: some version numbers go with them."""
    return pii.redact_documents(docs, columns=COLUMNS, base=True).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: rows repeat, those not taken go; rows are in their shards' shuffled order."""
    mixed = mixing.mix(docs).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_row"), F.posexplode("shards").alias("_pass", "_shard"), "shuffle_key").distinct()
    own = docs.withColumn("_row", mixing.row_hash("doc_id", "text"))
    rows = own.join(mixed, own["doc_id"].eqNullSafe(F.col("_id")) & (own["_row"] == mixed["_row"]))
    return rows.repartition(F.col("_shard"), F.pmod("shuffle_key", F.lit(16))).sortWithinPartitions("_shard", "shuffle_key", "_pass").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with digests of the ids and of what they decode to."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]
#: No stage but the plainest can be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written to the shared checkpoint folder and read again; what a stage needed is deleted once its result is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with Scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
