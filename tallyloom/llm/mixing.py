"""Mixing sources to target weights.

Every source's documents stand in a seeded order and are packed into blocks of a fixed number of words. The mix is a table of
slots, dealt to output shards: each shard draws how many of its slots go to which source from a multinomial distribution of
the targets. Running totals over the shards number a source's slots from 0; slot ``i`` takes block ``p(i)`` of the source's
``i // n``-th pass, where ``p`` is a pseudorandom permutation of its ``n`` blocks that is computed, not stored. Blocks and
documents are joined by source and block number.

Independent draws miss the targets a little. Slots beyond a source's target are given to the sources that are short, so every
source takes its target to within a block. A pass uses every block once and no target is more than ``cap`` sources, so no
document is taken more than ``ceil(cap)`` times.

Null text has size 0; a text without words is in no block and nothing of it is taken. A null source is a source of its own,
ordered last. Repeated rows are documents of their own. All choices follow hashes of seed, shard, source and id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeded import order_key, slice_of
from ..operators.ordering import total_before
from ..session import lookup_join, settle
from .common import WORD, text_of

# Weights of the sources in code-point order, repeating; share of all words; most passes over a source.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0

BLOCK = 256
SHARD_SLOTS = 4096
SEED = 7
# Slots that a task makes at once.
SLOTS_AT_ONCE = 500_000


def sized(documents: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, the source, and the number of words of every whole text."""
    size = F.regexp_count(text_of(F.col("text")), F.lit(WORD)).cast("bigint")
    return documents.select(*keep, F.col("source").cast("string").alias("source"), size.alias("size"))


def targets(rows: DataFrame, share: float = SHARE, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``rank, source, source_size, target``: one row per source.

    Targets are shares of the whole by weight, at most ``cap`` times the source, with the excess shared anew by weight. Along
    the sources by ``cap * size / weight`` that stops at a level: the first source whose limit is above the level of all that
    remain, and every source after it, takes its weight times that level.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source from here on.
    ordered = W.orderBy(F.col("source").isNull(), F.encode(F.coalesce("source", F.lit("")), "UTF-8"))
    ranked = sums.withColumn("rank", (F.row_number().over(ordered) - 1).cast("int"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("rank", F.lit(len(weights))) + 1)
    limit = F.col("source_size") * F.lit(cap)
    level = W.orderBy(F.col("limit") / F.col("weight"), "rank")
    every = W.partitionBy(F.lit(0))
    leveled = (
        ranked.withColumns({"weight": weight, "limit": limit})
        .withColumns(
            {
                "full": F.coalesce(F.sum("limit").over(level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
                "open": F.sum("weight").over(level.rowsBetween(W.currentRow, W.unboundedFollowing)),
                "whole": F.sum("source_size").over(every) * F.lit(share),
            }
        )
        .withColumn("level", (F.col("whole") - F.col("full")) / F.col("open"))
        .withColumn("stop", F.min(F.when(F.col("limit") / F.col("weight") > F.col("level"), F.struct(F.col("limit") / F.col("weight"), "rank", "level"))).over(every)["level"])
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("weight") * F.col("stop"), F.col("limit")))
    return leveled.select("rank", "source", "source_size", target.alias("target"))


def placed(rows: DataFrame, sources: DataFrame, seed: int, tie: list[str]) -> DataFrame:
    """Rows with their source's ``rank, source_size, target`` and ``start``, the words of the source before them."""
    marked = lookup_join(rows.withColumn("__s", F.coalesce("source", F.lit(""))).withColumn("__n", F.col("source").isNull()),
                         sources.select(F.coalesce("source", F.lit("")).alias("__s"), F.col("source").isNull().alias("__n"), "rank", "source_size", "target"),
                         ["__s", "__n"]).drop("__s", "__n")
    keyed = marked.withColumn("__h", order_key(seed, "rank", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in tie]))
    return total_before(keyed, ["rank"], ["__h", *tie], slice_of(F.col("__h")), "size", "start").drop("__h")


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A permutation of ``0 .. n-1`` for every key: four Feistel rounds over the next even number of bits, walked until
    the value is below ``n``."""
    half = (np.ceil(np.log2(np.maximum(n, 2))).astype(np.uint64) + np.uint64(1)) // np.uint64(2)
    mask = (np.uint64(1) << half) - np.uint64(1)
    value, key = index.astype(np.uint64), key.astype(np.uint64)
    walking = np.ones(len(value), bool)
    while walking.any():
        h, m, k = half[walking], mask[walking], key[walking]
        left, right = value[walking] >> h, value[walking] & m
        for r in range(4):
            x = (right + k + np.uint64(r * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((x ^ (x >> np.uint64(29))) & m)
        value[walking] = (left << h) | right
        walking[walking] = value[walking] >= n[walking].astype(np.uint64)
    return value.astype(np.int64)


def _draws(spark: SparkSession, sources: DataFrame, shard_slots: int, seed: int, block: int) -> DataFrame:
    """``rank, shard, first, count, blocks``: runs of slot numbers per source and shard."""
    plan = sources.where("source_size > 0").select(
        "rank", F.ceil(F.col("source_size") / block).alias("blocks"), "source_size", "target"
    )
    plan = plan.withColumn("slots", F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"),
                                            F.ceil(F.col("target") / F.col("source_size")).cast("bigint") * F.col("blocks")))
    plan = settle(plan.select("rank", "blocks", "slots"), "slots")
    every = plan.agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n"), F.sort_array(F.collect_list(F.struct("rank", "slots"))).alias("of"))
    # One row with an entry per source, sent to the shards; shards are rows made from the number of slots.
    total = every.first()
    ranks = np.array([x["rank"] for x in total["of"]], np.int64)
    wanted = np.array([x["slots"] for x in total["of"]], np.float64)
    n_slots = int(total["n"])
    shards = -(-n_slots // shard_slots)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                size = min(shard_slots, n_slots - shard * shard_slots)
                counts = np.random.default_rng([seed, shard]).multinomial(size, wanted / wanted.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ranks), shard, np.int64)), pa.array(ranks.astype(np.int32)), pa.array(counts.astype(np.int64))], names=["shard", "rank", "drawn"]
                )

    drawn = settle(spark.range(shards).mapInArrow(work, "shard bigint, rank int, drawn bigint").where("drawn > 0"), "draws")
    # A source's slots are numbered along the shards.
    numbered = total_before(drawn, ["rank"], ["shard"], F.floor(F.col("shard") / 1024), "drawn", "first").join(F.broadcast(plan), "rank")
    kept = numbered.withColumn("count", F.greatest(F.lit(0), F.least(F.col("drawn"), F.col("slots") - F.col("first"))))
    kept = settle(kept.select("rank", "shard", "first", "count", "blocks", (F.col("drawn") - F.col("count")).alias("over")), "kept")
    # Slots that shards drew beyond a source's target go, in order, to the sources that are short of it.
    short = plan.join(drawn.groupBy("rank").agg(F.sum("drawn").alias("got")), "rank", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    short = short.where("slots > got").select("rank", "blocks", F.explode(F.sequence("got", F.col("slots") - 1)).alias("first"))
    over = kept.where("over > 0").select("shard", F.explode(F.sequence(F.lit(1), F.col("over"))).alias("__k"), "rank")
    taker = total_before(short, [], ["rank", "first"], F.col("rank"), F.lit(1).cast("bigint"), "turn")
    giver = total_before(over, [], ["shard", "rank", "__k"], F.floor(F.col("shard") / 64), F.lit(1).cast("bigint"), "turn")
    moved = taker.join(giver.select("turn", "shard"), "turn").select("rank", "shard", "first", F.lit(1).cast("bigint").alias("count"), "blocks")
    return kept.where("count > 0").drop("over").unionByName(moved)


def slots(spark: SparkSession, sources: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``shard, rank, pass, block``: every slot of the mix with the block of its source that fills it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, shard, first, count, blocks = (batch.column(i).to_numpy() for i in range(5))
            for i in range(len(rank)):
                for a in range(0, int(count[i]), SLOTS_AT_ONCE):
                    index = first[i] + np.arange(a, min(a + SLOTS_AT_ONCE, int(count[i])), dtype=np.int64)
                    turn = index // blocks[i]
                    key = (np.uint64(seed) << np.uint64(40)) + np.uint64(int(rank[i]) * 1009) + turn.astype(np.uint64) * np.uint64(0x1F123BB5)
                    taken = permuted(index % blocks[i], np.full(len(index), blocks[i]), key)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(index), shard[i])), pa.array(np.full(len(index), rank[i], np.int32)), pa.array(turn), pa.array(taken)],
                        names=["shard", "rank", "pass", "block"],
                    )

    runs = _draws(spark, sources, shard_slots, seed, block).select("rank", "shard", "first", "count", "blocks")
    return runs.mapInArrow(work, "shard bigint, rank int, pass bigint, block bigint")


def in_blocks(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows of texts with words, once per block that holds words of them: ``block``, and the words ``lo`` to ``hi`` of the text."""
    parts = rows.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)))
    )
    return parts.withColumns(
        {
            "lo": F.greatest(F.lit(0), F.col("block") * block - F.col("start")),
            "hi": F.least(F.col("size"), (F.col("block") + 1) * block - F.col("start")),
        }
    )


def taken_words(spark: SparkSession, documents: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source``: what the mix takes of every document."""
    rows = settle(sized(documents.withColumn("__t", F.xxhash64("text")), ["doc_id", "__t"]), "sizes")
    sources = settle(targets(rows), "targets")
    order = settle(placed(rows, sources, seed, ["doc_id", "__t", "size"]), "placed")
    times = slots(spark, sources, block, shard_slots, seed).groupBy("rank", "block").agg(F.count("*").alias("times"))
    columns = ["rank", "start", "doc_id", "source", "size", "source_size", "target"]
    met = in_blocks(order.select(*columns), block).join(times, ["rank", "block"], "left")
    some = met.groupBy(*columns).agg(F.sum((F.col("hi") - F.col("lo")) * F.coalesce("times", F.lit(0))).alias("taken"))
    none = order.where("size = 0").select(*columns, F.lit(0).cast("bigint").alias("taken"))
    return some.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", "source")


def mixed_documents(spark: SparkSession, documents: DataFrame, block: int = BLOCK, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """The mix as documents: a row per document and pass that takes words of it, with those words.

    Of every run of taken words the text is kept as it is, with the white space inside it; the runs of a pass are joined by
    a line feed. A document taken whole is unchanged but for white space at its ends. ``n_chars`` is the length of the new
    text; the other columns stay. Documents without words are left out: no block holds them. Further
    columns may have any name that does not start with ``__mix_``.
    """
    marked = documents.withColumn("__mix_t", F.xxhash64("text"))
    rows = settle(sized(marked, ["doc_id", "__mix_t"]), "sizes")
    sources = settle(targets(rows), "targets")
    tie = ["doc_id", "__mix_t", "size"]
    order = settle(placed(rows, sources, seed, tie), "placed")
    drawn = slots(spark, sources, block, shard_slots, seed).select("rank", "block", "pass")
    met = in_blocks(order.select("rank", "start", "size", "doc_id", "__mix_t"), block).join(drawn, ["rank", "block"])
    runs = met.groupBy("rank", "start", "doc_id", "__mix_t", "pass").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("__mix_runs"))
    # Copies of a row with the same id and text may take each other's words: number them on both sides.
    same = W.partitionBy("doc_id", "__mix_t").orderBy("start")
    numbered = order.where("size > 0").select("rank", "start", "doc_id", "__mix_t", F.row_number().over(same).alias("__mix_copy"))
    wanted = runs.join(numbered.select("rank", "start", "__mix_copy"), ["rank", "start"]).select("doc_id", "__mix_t", "__mix_copy", "pass", "__mix_runs")
    copies = marked.withColumn("__mix_copy", F.row_number().over(W.partitionBy("doc_id", "__mix_t").orderBy("source")))
    joined = copies.join(
        wanted, copies["doc_id"].eqNullSafe(wanted["doc_id"]) & (copies["__mix_t"] == wanted["__mix_t"]) & (copies["__mix_copy"] == wanted["__mix_copy"])
    ).select(*[copies[c] for c in documents.columns], wanted["__mix_runs"])
    cut = joined.withColumn("text", cut_words(F.col("text"), F.col("__mix_runs"))).drop("__mix_runs")
    return cut.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in documents.columns else cut


def cut_words(text, runs):
    """Words ``lo`` to ``hi`` of every run, with the white space between them; runs that touch are one."""
    parts = F.regexp_extract_all(text, F.lit(f"({WORD})([^\\S]*)".replace("[^\\S]", "[\\x20\\x09-\\x0D]")), F.lit(0))
    merged = F.aggregate(
        runs,
        F.array().cast("array<struct<lo:bigint,hi:bigint>>"),
        lambda done, r: F.when(
            (F.size(done) > 0) & (F.element_at(done, -1)["hi"] == r["lo"]),
            F.concat(
                F.slice(done, F.lit(1), F.size(done) - 1),
                F.array(F.struct(F.element_at(done, -1)["lo"].alias("lo"), r["hi"].alias("hi"))),
            ),
        ).otherwise(F.concat(done, F.array(F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"))))),
    )
    piece = F.transform(
        merged,
        lambda r: F.rtrim(F.array_join(F.slice(parts, (r["lo"] + 1).cast("int"), (r["hi"] - r["lo"]).cast("int")), ""), F.lit(" \t\n\x0b\x0c\r")),
    )
    return F.array_join(piece, "\n")
