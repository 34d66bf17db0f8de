"""Queries of the operators, each over its whole table with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    bpe,
    centroid_clusters,
    class_lm,
    embedding_dedup,
    fingerprints,
    html_extract,
    mixing,
    near_dedup,
    pii,
    quality_rules,
    spelling_trie,
    token_counts,
    toxicity,
)
from .common import fold, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
RANKS = "byte_bpe_multi_50k.tiktoken"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source")


@query("op1_document_fingerprints")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(documents(spark, sf_dir))


@query("op2_class_lm")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.model_scores(spark, documents(spark, sf_dir).withColumn("train", fold(F.col("doc_id")) != 1))


@query("op3_byte_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path(RANKS)
    digests = ["n_tokens", "ids_sha256", "decoded_sha256"]
    return bpe.encode(spark, documents(spark, sf_dir), ["doc_id"], ranks, public_tokenizers.PATTERN, digests)


@query("op4_minhash_near_dedup")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_duplicates(documents(spark, sf_dir), "doc_id", 3, 85)
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


@query("op5_source_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(spark, documents(spark, sf_dir))


@query("op6_pii")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(documents(spark, sf_dir), "doc_id")


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).withColumn("held_out", fold(F.col("doc_id")) == 0)
    net = toxicity.fitted(docs.where("NOT held_out"), table(spark, sf_dir, "labels"))
    scores = toxicity.scored(spark, docs, net, ["doc_id", "held_out"])
    return scores.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query("op8_embedding_near_dedup")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(spark, table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query("op9_main_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extracted(spark, pages, html_extract.fitted(pages))


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    edits = token_counts.sample_edits(F.col("text"))
    return token_counts.counted(spark, docs, "doc_id", edits, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


@query("op11_quality_rules")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(documents(spark, sf_dir), table(spark, sf_dir, "labels"), "doc_id", fold(F.col("doc_id")) != 0)


@query("op12_centroid_clusters", centroid_clusters.oracle(k=8, rounds=10, size=64, scale=1024, seed=3))
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return centroid_clusters.clusters(vectors, "vec_id", "embedding", k=8, rounds=10, size=64, scale=1024, seed=3)


@query("op13_spelling_variants", spelling_trie.oracle(every=199, shortest=6, rarest=5, times=5))
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_trie.variants(documents(spark, sf_dir), "doc_id", "text", every=199, shortest=6, rarest=5, times=5)
