"""Do training prompts contain evaluation problems? Shared n-grams of unsupervised text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.once import let, pinned
from ..functions.text import ngram_hashes
from ..session import lookup_join, settle

GRAM = 13
SHORTEST = 30


def problem_grams(problems: DataFrame, n: int = GRAM, shortest: int = SHORTEST) -> DataFrame:
    """``item_id, gram`` of the distinct n-grams of every problem of at least ``shortest`` tokens."""
    long_enough = problems.filter(F.size("tokens") >= shortest)
    return long_enough.select("item_id", F.explode(F.array_distinct(ngram_hashes(F.col("tokens"), n))).alias("gram"))


def problem_totals(grams: DataFrame) -> DataFrame:
    """N-grams per problem, counted before ownership, so n-grams shared by problems lower the later one's coverage."""
    return grams.groupBy("item_id").agg(F.count("*").alias("total"))


def gram_owner(grams: DataFrame) -> DataFrame:
    """An n-gram shared by several problems belongs to the first."""
    return grams.groupBy("gram").agg(F.min("item_id").alias("item_id"))


def prompt_grams(rows: DataFrame, n: int = GRAM) -> DataFrame:
    """``id, gram`` of the distinct n-grams of windows without supervised tokens. A null mask means all unsupervised."""

    def unsupervised(m):
        starts = F.sequence(F.lit(0), F.greatest(F.size(m) - n, F.lit(0)))
        return F.transform(starts, lambda i: F.greatest(*[F.get(m, i + j) for j in range(n)]) == 0)

    open_windows = F.when(F.col("mask").isNotNull(), let(F.col("mask"), unsupervised))
    made = pinned(rows, {"grams": ngram_hashes(F.col("tokens"), n), "open": open_windows}, ["id"])
    kept = F.transform(F.filter(F.arrays_zip("grams", "open"), lambda p: p["open"]), lambda p: p["grams"])
    chosen = F.when(F.col("open").isNull(), F.col("grams")).otherwise(F.filter(kept, lambda g: g.isNotNull()))
    return made.select("id", F.explode(F.array_distinct(chosen)).alias("gram"))


def ngram_hits(rows: DataFrame, problems: DataFrame, n: int = GRAM, shortest: int = SHORTEST) -> DataFrame:
    """``id, item_id, found, total, coverage`` for every training row and problem that share an n-gram.

    The index holds one owner per n-gram, so a row's n-gram joins at most one problem. It is broadcast while small; with
    a bigger index the most frequent n-grams (boilerplate sits in most rows) are still joined by broadcast.
    """
    grams = settle(problem_grams(problems, n, shortest), "grams")
    hits = lookup_join(prompt_grams(rows, n), gram_owner(grams), ["gram"])
    found = hits.groupBy("id", "item_id").agg(F.count("*").alias("found"))
    return lookup_join(found, problem_totals(grams), ["item_id"]).withColumn(
        "coverage", F.col("found") / F.col("total")
    )


def contamination(hits: DataFrame, totals: DataFrame) -> DataFrame:
    """Per tested problem: best coverage, the row that has it (smallest id on ties), rows at >= 0.5 and >= 0.9."""
    best = hits.groupBy("item_id").agg(
        F.min(F.struct((-F.col("coverage")).alias("c"), "id")).alias("b"),
        F.count_if(F.col("coverage") >= 0.5).alias("n50"),
        F.count_if(F.col("coverage") >= 0.9).alias("n90"),
    )
    return totals.join(best, "item_id", "left").select(
        "item_id",
        "total",
        F.coalesce(-F.col("b.c"), F.lit(0.0)).alias("best"),
        F.col("b.id").alias("best_row"),
        F.coalesce("n50", F.lit(0)).alias("n50"),
        F.coalesce("n90", F.lit(0)).alias("n90"),
    )


def flagged_share(summary: DataFrame, sets: DataFrame, by: str = "set", least: float = 0.5) -> DataFrame:
    """Per problem set: problems, those tested, those flagged, and their share of the tested. ``sets``: ``item_id, <by>``."""
    marked = sets.join(summary.select("item_id", "best"), "item_id", "left")
    tested, flagged = F.count("best"), F.count_if(F.col("best") >= least)
    return marked.groupBy(by).agg(
        F.count("*").alias("n_items"), tested.alias("n_tested"), flagged.alias("n_flagged"),
        F.when(tested > 0, flagged / tested).alias("share"),
    )


def flagged_items(summary: DataFrame, least: float = 0.5) -> DataFrame:
    """Problems to remove; problems too short to test never appear in the summary and stay."""
    return summary.filter(F.col("best") >= least).select("item_id")
