"""Totals, quantiles, histograms and share tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markers as M
from ..session import lookup_join, settle

PERCENTS = (10, 50, 90, 99)


def source_totals(stats: DataFrame, length: int) -> DataFrame:
    """Per source and for all (source null): rows in, kept, clipped and dropped, tokens kept and supervised.

    ``stats``: ``source, n_tokens, n_supervised, n_supervised_clipped``, the last counted inside the first ``length``
    tokens; a row with none of those is dropped.
    """
    kept = F.col("n_supervised_clipped") > 0
    long = F.col("n_tokens") > length
    return stats.rollup("source").agg(
        F.count("*").alias("rows_in"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(long).alias("rows_clipped"),
        F.sum(F.when(long, F.col("n_tokens") - length).otherwise(0)).alias("tokens_clipped"),
        F.count_if(~kept).alias("dropped_unsupervised"),
        F.sum(F.when(kept, F.least("n_tokens", F.lit(length))).otherwise(0)).alias("tokens_kept"),
        F.sum(F.when(kept, F.col("n_supervised_clipped")).otherwise(0)).alias("tokens_supervised"),
    )


def distinct_sum(rows: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Sum of ``value`` per group, each key counted once per group, and over all groups' distinct keys (group null)."""
    once = rows.groupBy(group, key).agg(F.max(value).alias(value))
    per_group = once.groupBy(group).agg(F.count("*").alias("n_keys"), F.sum(value).alias("total"))
    overall = (
        once.groupBy(key).agg(F.max(value).alias(value)).agg(F.count("*").alias("n_keys"), F.sum(value).alias("total"))
    )
    return per_group.unionByName(overall.withColumn(group, F.lit(None).cast(rows.schema[group].dataType)))


def exact_dedup(rows: DataFrame, text: str = "text", key: str = "id") -> DataFrame:
    """One row per distinct text: the one with the smallest key. Rows without a text or key are kept.

    Texts are hashed once into a written (key, hash) table. Copies are found there, combined before the shuffle, and the
    keys to drop are taken out of the rows: texts do not move unless that list is too long to broadcast.
    """
    hashed = settle(rows.select(key, F.sha2(F.col(text), 256).alias("__h")), "hashes")
    copied = (
        hashed.groupBy("__h").agg(F.min(key).alias("__keep"), F.count("*").alias("__n")).filter("__n > 1").drop("__n")
    )
    extra = lookup_join(hashed, copied, ["__h"]).filter(F.col(key) != F.col("__keep")).select(key)
    return rows.join(settle(extra, "copies"), key, "left_anti")


def length_quantiles(lengths: DataFrame, qs: list[float], by: list[str], value: str = "n") -> DataFrame:
    """Exact percentiles and the nearest-rank median per group, from the histogram of the lengths."""
    hist = lengths.groupBy(*by, value).agg(F.count("*").alias("c"))
    upto = W.partitionBy(*by).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    ranked = hist.withColumn("__upto", F.sum("c").over(upto)).withColumn("__all", F.sum("c").over(whole))
    middle = F.min(F.when(F.col("__upto") > F.floor(F.col("__all") / 2), F.col(value))).alias("median_rank")
    quantiles = [F.percentile(value, F.lit(q), F.col("c")).alias(f"p{int(round(q * 100))}") for q in qs]
    return ranked.groupBy(*by).agg(F.sum("c").alias("n_rows"), *quantiles, middle, F.max(value).alias("longest"))


def log2_bucket(length: Column, last: int = 19) -> Column:
    """min(last, floor(log2(length + 1))), exactly, from the binary digits."""
    return F.least(F.lit(last), F.length(F.bin((length + 1).cast("bigint"))) - 1)


def length_hist(lengths: DataFrame, by: list[str], value: str = "n") -> DataFrame:
    return lengths.groupBy(*by, log2_bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n_rows"))


def length_bands(lengths: DataFrame, edges: list[int], by: list[str], value: str = "n") -> DataFrame:
    """Rows and share of rows per band ``[edge, next edge)`` of the true length; the last band is open."""
    band = F.lit(None).cast("int")
    for edge in edges:
        band = F.when(F.col(value) >= edge, F.lit(edge)).otherwise(band)
    counted = lengths.groupBy(*by, band.alias("band")).agg(F.count("*").alias("n_rows"))
    return counted.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(W.partitionBy(*by)))


def threshold_table(lengths: DataFrame, thresholds: list[int], value: str = "n") -> DataFrame:
    """Per threshold t: rows and tokens at length >= t and the row share, in one pass over the data."""
    sums = [F.count("*").alias("all_rows")]
    for t in thresholds:
        at = F.col(value) >= t
        sums += [F.count_if(at).alias(f"r{t}"), F.sum(F.when(at, F.col(value)).otherwise(0)).alias(f"t{t}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(t).alias("threshold"),
                F.col(f"r{t}").alias("rows_at"),
                (F.col(f"r{t}") / F.col("all_rows")).alias("share"),
                F.col(f"t{t}").alias("tokens_at"),
            )
            for t in thresholds
        ]
    )
    return lengths.agg(*sums).select(F.inline(rows))


def clip_keep_rate(stats: DataFrame, clips: list[int]) -> DataFrame:
    """Share of tokens kept at every clip length, one pass."""
    sums = [F.sum("n").alias("all_tokens")] + [F.sum(F.least("n", F.lit(c))).alias(f"k{c}") for c in clips]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("clip"),
                F.col(f"k{c}").alias("tokens_kept"),
                (F.col(f"k{c}") / F.col("all_tokens")).alias("keep_rate"),
            )
            for c in clips
        ]
    )
    return stats.agg(*sums).select(F.inline(rows))


def selection_summary(selected: DataFrame, universe: DataFrame) -> DataFrame:
    """One row: rows, unique and duplicate rows, tokens, and the 10th, 50th, 90th and 99th percentile of the lengths of the
    selection and of the universe."""

    def percentiles(df: DataFrame, name: str) -> list[Column]:
        counts = df.groupBy("n").agg(F.count("*").alias("c"))
        at = counts.agg(F.percentile("n", F.array(*[F.lit(q / 100) for q in PERCENTS]), F.col("c")).alias("m")).scalar()
        return [at[i].alias(f"{name}_p{q}" if q != 50 else f"{name}_median") for i, q in enumerate(PERCENTS)]

    copies = selected.groupBy("id").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    return copies.agg(
        F.sum("c").alias("selected_rows"),
        F.count("*").alias("unique_rows"),
        (F.sum("c") - F.count("*")).alias("duplicate_rows"),
        F.sum("n").alias("selected_tokens"),
    ).select(
        "*", *percentiles(selected, "selected"), *percentiles(universe, "universe")
    )


def score_by_rank(selected: DataFrame) -> DataFrame:
    return selected.groupBy("rank").agg(F.count("*").alias("n_rows"), F.avg("score").alias("mean_score"))


def status_counts(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by, status).agg(F.count("*").alias("n_rows"))


def mode_crosstab(stats: DataFrame, window: int) -> DataFrame:
    """Rows, tokens, supervised, prompt tokens, turns and window-filling rows by mode and terminal flag, with totals.

    Rows without a supervised token count as rows, tokens and empty rows only.
    """
    trained = F.col("n_supervised") > 0
    return stats.cube("mode", "terminal").agg(
        F.count("*").alias("n_rows"),
        F.sum("n_tokens").alias("tokens"),
        F.sum("n_supervised").alias("supervised"),
        F.sum(F.when(trained, F.col("n_tokens") - F.col("n_supervised")).otherwise(0)).alias("prompt_tokens"),
        F.sum(F.when(trained, F.col("n_assistant")).otherwise(0)).alias("turns"),
        F.count_if(trained & (F.col("n_tokens") >= window)).alias("window_rows"),
        F.count_if(~trained).alias("empty_rows"),
    )


# ---- text features ---------------------------------------------------------------------------------------------


def marker_rates(replies: DataFrame, by: list[str], text: str = "text", n: str = "n") -> DataFrame:
    """Marker words per 1000 supervised tokens."""
    counts = [
        F.sum(F.regexp_count(text, F.lit(rf"\b{w}\b"))).alias(w.lower().replace(" ", "_")) for w in M.MARKER_WORDS
    ]
    sums = replies.groupBy(*by).agg(F.sum(n).alias("tokens"), *counts)
    names = [w.lower().replace(" ", "_") for w in M.MARKER_WORDS]
    return sums.select(*by, "tokens", *[(F.col(c) * 1000.0 / F.col("tokens")).alias(c) for c in names])


def prompt_features(prompts: DataFrame, by: list[str], text: str = "text") -> DataFrame:
    """Shares of prompts that ask for a box, say step by step, hold a code fence or LaTeX, or are over 30% non-ASCII."""
    t = F.col(text)
    low = F.lower(t)
    ascii_left = F.length(F.regexp_replace(t, r"[^\x00-\x7f]", ""))
    flags = {
        "boxed": F.instr(t, "boxed") > 0,
        "step_by_step": (F.instr(low, "step by step") > 0) | (F.instr(low, "step-by-step") > 0),
        "fence": F.instr(t, "```") > 0,
        "latex": (F.instr(t, "$") > 0) | (F.instr(t, "\\(") > 0) | (F.instr(t, "\\[") > 0),
        "non_ascii": (F.length(t) > 0) & ((F.length(t) - ascii_left) / F.length(t) > 0.3),
    }
    return prompts.groupBy(*by).agg(
        F.count("*").alias("n_rows"), *[(F.count_if(v) / F.count("*")).alias(k) for k, v in flags.items()]
    )
