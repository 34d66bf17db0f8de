"""A corpus pipeline: reject toxic documents, keep one of each near-duplicate group, redact personal data, mix, encode.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame. ``run`` writes the result of each stage as Parquet to the
session's shared folder and reads it again as the next stage's ``docs``. All stages but the last return the columns of
``documents``.

- toxicity: documents with a score of 0.5 or more go. The network learns from the labels of documents whose
  ``crc32(doc_id) mod 5`` is not 0.
- near-duplicates: five-word shingles, similarity 0.8 or more; the document with the smallest id of a group stays.
- personal data: every span is replaced by its kind in angle brackets.
- mixing: sources weigh 3, 1, 2, repeating, and share 150 % of all words, at most twice a source; a document that is taken
  twice appears twice, and one that is taken in part has those words.
- encoding: byte-level BPE ids of every text, decoded again.

Null texts count as empty: not toxic unless the network says so of an empty text, no near-duplicates, no personal data; the
mix takes no text without words. A table without rows gives one without rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, mixing, near_dedup, pii, toxicity
from tallyloom.llm.common import fold, table
from tallyloom.session import settle

RANKS = "byte_bpe_multi_50k.tiktoken"
SHINGLE, PERCENT = 5, 80


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    net = toxicity.fitted(docs.where(fold(F.col("doc_id")) != 0), table(spark, sf_dir, "labels"))
    return toxicity.scored(spark, docs, net, docs.columns, "__score").where("__score < 0.5").drop("__score")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.one_of_each(docs, "doc_id", SHINGLE, PERCENT)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(spark, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    asked = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    return bpe.encode(spark, docs, ["doc_id"], public_tokenizers.path(RANKS), public_tokenizers.PATTERN, asked)


STAGES = [
    ("toxicity", reject_toxic),
    ("minhash_near_dedup", keep_one),
    ("pii", redact),
    ("source_mix", mix),
    ("byte_bpe", encode),
]

# Networks, MinHash and byte-level BPE cannot be said in SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
