"""Texts of many sources under per-source token budgets to sharded, loss-masked token rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import aggregates as A
from ..operators import selection as S
from ..operators import token_rows as T
from ..operators.ordering import prefix_select
from ..session import lookup_join, settle
from ..sources import writers as K

# Chosen rows are broadcast up to so many; more are joined by a shuffle, so the driver does not get them.
CHOSEN_ROWS = 100_000


def curate(
    texts: DataFrame,
    mix: DataFrame,
    path: str,
    length: int,
    shard_tokens: int,
    seed: int,
    sample_rows: int | None = None,
    allow_partial: bool = False,
    whole: bool = False,
    tokenizer: T.IdTokenizer | None = None,
    parts: int = 1,
    resume: bool = False,
) -> DataFrame:
    """Write the curated set below ``path`` (rows, manifest, token frequencies) and return its manifest.

    ``texts``: ``id, source, text`` rendered with role headers; ``mix``: ``source, allocated``. A first pass keeps only the
    lengths of every text; selection and all counters come from them, and only chosen texts are tokenised into shards. With
    a ``tokenizer`` of integer ids the rows are ``input_ids, loss_mask, seq_len``, else ``tokens, mask, n``.

    A source below its allocation stops the job unless ``allow_partial``; with ``whole`` every source is taken whole,
    whatever its allocation says. Shards are written in ``parts`` jobs; ``resume`` leaves out those an earlier run finished.
    """
    spark = texts.sparkSession
    build = (lambda rows: T.masked_rows(rows, "id", keep=["source"])) if tokenizer is None else (lambda rows: T.id_rows(rows, tokenizer, keep=["source"]))
    inside = T.supervised(F.slice("mask", 1, length))
    stats = settle(build(texts).select("source", "id", F.col("n").cast("bigint").alias("n"), inside.alias("n_supervised")), "stats")
    mix = settle(mix, "mix")
    status = S.allocation_status(mix, stats, whole)
    if not allow_partial:
        S.refuse_partial(status)
    if sample_rows:
        targets = S.scale_allocation(stats, mix, sample_rows)
    elif whole:
        targets = status.filter("store_tokens IS NOT NULL").select("source", F.col("store_tokens").alias("target"))
    else:
        targets = mix.withColumnRenamed("allocated", "target")
    chosen = settle(prefix_select(stats, settle(targets.select("source", "target"), "targets"), ["source"], ["id"], "n", seed), "chosen")
    expected = chosen.agg(F.sum("n").alias("t")).first().t or 0
    n_shards = K.shard_count(expected, shard_tokens)

    wanted = settle(chosen.filter("n_supervised > 0").select("source", "id"), "wanted")
    picked = lookup_join(texts, wanted, ["source", "id"], "left_semi", limit=CHOSEN_ROWS, settled=True)
    names = ("tokens", "mask", "n") if tokenizer is None else ("input_ids", "loss_mask", "seq_len")
    counters = {"kept": F.count(F.lit(1)), "bad": F.count_if(~T.sound(length, *names))}
    kept = 0
    for part in range(parts):
        target = f"{path}/rows/part={part}"
        if resume and K.finished(spark, target):
            seen = spark.read.parquet(target).agg(*[c.alias(name) for name, c in counters.items()]).first().asDict()
            kept += _whole(seen)
            continue
        mine = K.shard_columns(picked, n_shards, seed).filter(F.pmod("shard", F.lit(parts)) == part).drop("shard", "h")
        rows = _named(T.clip(build(mine), length), tokenizer)
        kept += _whole(K.write_sharded(rows, target, n_shards, seed, resume=resume, counters=counters))

    written = _unnamed(spark.read.parquet(f"{path}/rows"), tokenizer)
    counted = A.source_totals(
        chosen.select("source", F.col("n").alias("n_tokens"), F.col("n_supervised").alias("n_supervised_clipped")), length
    ).withColumns({"seed": F.lit(seed), "seq_length": F.lit(length), "shards": F.lit(n_shards), "partial": F.lit(allow_partial)})
    manifest = settle(counted, "manifest")
    if kept != (manifest.filter("source IS NULL").first() or {"rows_kept": 0})["rows_kept"]:
        raise ValueError("the shards do not hold the rows that were kept")
    if not (resume and K.finished(spark, f"{path}/manifest")):
        manifest.coalesce(1).write.mode("overwrite" if resume else "errorifexists").json(f"{path}/manifest")
    if not (resume and K.finished(spark, f"{path}/token_freq")):
        T.token_freq(written).write.mode("overwrite" if resume else "errorifexists").parquet(f"{path}/token_freq")
    return manifest


def _whole(seen: dict) -> int:
    """The rows counted while writing, none of which may break an invariant."""
    if seen["bad"]:
        raise ValueError(f"{seen['bad']} written rows break an invariant")
    return seen["kept"]


def _named(rows: DataFrame, tokenizer: T.IdTokenizer | None) -> DataFrame:
    """Rows under the names that training reads."""
    if tokenizer is None:
        return rows
    return rows.withColumnsRenamed({"tokens": "input_ids", "mask": "loss_mask", "n": "seq_len"})


def _unnamed(rows: DataFrame, tokenizer: T.IdTokenizer | None) -> DataFrame:
    if tokenizer is None:
        return rows
    return rows.withColumnsRenamed({"input_ids": "tokens", "loss_mask": "mask", "seq_len": "n"})


def curated_totals(texts: DataFrame, length: int) -> DataFrame:
    """Keep, clip and drop counters per source and in total, without writing."""
    rows = T.masked_rows(texts, "id", keep=["source"])
    stats = rows.select(
        "source", F.col("n").alias("n_tokens"), T.supervised(F.slice("mask", 1, length)).alias("n_supervised_clipped")
    )
    return A.source_totals(stats, length)


def selected_shards(spark: SparkSession, sf_dir: str, n_shards: int = 4, seed: int = 7) -> DataFrame:
    """Half of every source's tokens, by source and shard: rows and tokens."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stats = settle(
        documents.select("source", F.col("doc_id").alias("id"), word_count(F.col("text")).cast("bigint").alias("n")), "stats"
    )
    targets = stats.groupBy("source").agg(F.floor(F.sum("n") / 2).alias("target"))
    chosen = S.budget_select(stats, targets, seed)
    return (
        K.shard_columns(chosen, n_shards, seed)
        .groupBy("source", "shard")
        .agg(F.count("*").alias("n_rows"), F.sum("n").alias("tokens"))
    )
