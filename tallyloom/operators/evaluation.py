"""Acceptance, throughput and step-log reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import settle
from .ordering import in_slices, total_before


def previous_in_slices(rows: DataFrame, group: list[str], order: str, slice_by: Column, value: str, out: str) -> DataFrame:
    """Value of the row just before in the group, without one task per group.

    Rows look back inside their slice; the first row of a slice takes the last value of the slice before, from a small
    table with one row per slice. ``slice_by`` must never decrease along ``order``.
    """
    sliced = in_slices(rows, group, slice_by)
    ends = sliced.groupBy(*group, "__slice").agg(
        F.max(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))).alias("__end")
    )
    before = W.partitionBy(*group).orderBy("__slice")
    carried = ends.select(*group, "__slice", F.lag("__end.v").over(before).alias("__carried"))
    inside = W.partitionBy(*group, "__slice").orderBy(order)
    return (
        sliced.join(carried, [*group, "__slice"])
        .withColumn(
            out,
            F.when(F.row_number().over(inside) == 1, F.col("__carried")).otherwise(F.lag(value).over(inside)),
        )
        .drop("__slice", "__carried")
    )


# ---- counters --------------------------------------------------------------------------------------------------


def counter_delta(scrapes: DataFrame, slice_by: Column) -> DataFrame:
    """Increment since the scrape before, per engine and counter; a counter that fell was reset and starts from zero.

    ``scrapes``: ``engine, name, scrape, value``. The first scrape has no increment.
    """
    seen = previous_in_slices(scrapes, ["engine", "name"], "scrape", slice_by, "value", "__before")
    step = F.when(F.col("value") >= F.col("__before"), F.col("value") - F.col("__before")).when(
        F.col("__before").isNotNull(), F.col("value")
    )
    return seen.withColumn("delta", step).drop("__before")


def acceptance(counters: DataFrame, by: str = "subset", positions: int = 0, counts: tuple[str, ...] = ()) -> DataFrame:
    """Pooled acceptance per subset and for all (subset ``all``).

    ``counters``: ``drafts, draft_tokens, accepted_tokens`` and ``pos_0 ..``. Rates are ratios of sums, never averages of
    rates. ``counts`` names further columns to sum, such as requests and failed requests.
    """
    sums = [*counts, "drafts", "draft_tokens", "accepted_tokens", *[f"pos_{i}" for i in range(positions)]]
    pooled = counters.rollup(by).agg(*[F.sum(c).alias(c) for c in sums])
    per_draft = [(F.col(f"pos_{i}") / F.col("drafts")).alias(f"acceptance_at_pos_{i}") for i in range(positions)]
    return pooled.filter("drafts > 0").select(
        F.coalesce(by, F.lit("all")).alias(by),
        *counts,
        "drafts",
        "draft_tokens",
        "accepted_tokens",
        (1 + F.col("accepted_tokens") / F.col("drafts")).alias("acceptance_length"),
        *per_draft,
    )


def throughput(results: DataFrame, by: list[str]) -> DataFrame:
    """Pooled tokens per second: total tokens over total seconds."""
    return results.groupBy(*by).agg(
        F.sum("tokens").alias("tokens"),
        F.sum("seconds").alias("seconds"),
        (F.sum("tokens") / F.sum("seconds")).alias("tokens_per_s"),
    )


def speedup(pairs: DataFrame) -> DataFrame:
    """Drafter over plain tokens per second of paired arms."""
    rate, plain = F.col("tokens") / F.col("seconds"), F.col("plain_tokens") / F.col("plain_seconds")
    return pairs.filter(F.col("plain_tokens") > 0).select(
        "benchmark", "arm", "level", plain.alias("plain_tok_s"), rate.alias("tok_s"), (rate / plain).alias("speedup")
    )


def accepted_length(blocks: DataFrame) -> DataFrame:
    """Per block: leading run of correct slots plus one, and the expected length from the slot rates.

    ``blocks``: ``block, correct ARRAY<BOOLEAN>, rate ARRAY<DOUBLE>`` in slot order.
    """
    miss = F.array_position("correct", F.lit(False))
    run = F.when(miss > 0, miss - 1).otherwise(F.size("correct"))
    expected = F.aggregate(
        "rate",
        F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("s")),
        lambda a, r: F.struct((a["p"] * r).alias("p"), (a["s"] + a["p"] * r).alias("s")),
        lambda a: a["s"],
    )
    return blocks.select("block", (run + 1).alias("accepted"), expected.alias("expected"))


def two_arm_table(runs: DataFrame, arms: list[str]) -> DataFrame:
    """Per mode and task: mean, spread and runs of two arms, and their gap (null when an arm is missing).

    ``runs``: ``mode, task, arm, seed, acceptance_length``.
    """
    a, b = arms
    wide = (
        runs.groupBy("mode", "task")
        .pivot("arm", arms)
        .agg(
            F.avg("acceptance_length").alias("mean"),
            (F.max("acceptance_length") - F.min("acceptance_length")).alias("spread"),
            F.count("acceptance_length").alias("runs"),
        )
    )
    return wide.withColumn("gap", F.col(f"`{a}_mean`") - F.col(f"`{b}_mean`"))


def mean_gap(table: DataFrame) -> DataFrame:
    return table.groupBy("mode").agg(F.avg("gap").alias("mean_gap"), F.count("gap").alias("tasks"))


def method_summary(runs: DataFrame, data: DataFrame, neutral: list[str]) -> DataFrame:
    """Per method: data seen, unique data seen, and the mean over the neutral benchmarks (null unless all are there).

    ``runs``: ``method, benchmark, acceptance_length``; ``data``: ``method, rows, tokens, supervised, train_share,
    epoch_steps, step``.
    """
    is_neutral = F.col("benchmark").isin(*neutral)
    scores = runs.groupBy("method").agg(
        F.avg(F.when(is_neutral, F.col("acceptance_length"))).alias("m"),
        F.count(F.when(is_neutral, F.col("acceptance_length"))).alias("c"),
    )
    train_rows, train_sup = F.col("rows") * F.col("train_share"), F.col("supervised") * F.col("train_share")
    seen = train_sup / F.col("epoch_steps") * F.col("step")
    return data.join(scores, "method", "left").select(
        "method",
        (F.col("tokens") / F.col("rows")).alias("tokens_per_row"),
        (F.col("supervised") / F.col("rows")).alias("supervised_per_row"),
        (train_rows / F.col("epoch_steps")).alias("rows_per_step"),
        (F.col("step") / F.col("epoch_steps")).alias("epochs_seen"),
        seen.alias("supervised_seen"),
        F.least(seen, train_sup).alias("unique_supervised_seen"),
        F.when(F.col("c") == len(neutral), F.col("m")).alias("mean_neutral"),
    )


def accept_curve(log: DataFrame, width: int) -> DataFrame:
    """Equal-weight mean per arm and request bin ``lo < done <= lo + width``. ``log``: ``arm, done, accept``."""
    return log.groupBy("arm", (F.ceil(F.col("done") / width) - 1).alias("bin")).agg(
        F.count("*").alias("n_rows"), F.avg("accept").alias("mean_accept")
    )


def moving_average(log: DataFrame, w: int, per_slice: int = 100_000) -> DataFrame:
    """Mean of each record and the ``w`` before it, per arm. ``log``: ``arm, done, accept``; ``done`` grows, by any steps.

    Records are numbered per arm. Totals up to a record come from sliced prefix sums, and a window mean is a difference of
    two of them, so the cost does not depend on ``w`` and no arm is walked by one task.
    """
    slices = F.floor(F.col("done") / per_slice)
    rows = log.select("arm", "done", "accept")
    numbered = total_before(rows, ["arm"], ["done"], slices, F.lit(1).cast("bigint"), "nth")
    upto = settle(total_before(numbered, ["arm"], ["nth"], F.floor(F.col("nth") / per_slice), "accept", "before"), "totals")
    older = upto.select("arm", (F.col("nth") + w + 1).alias("nth"), (F.col("before") + F.col("accept")).alias("cut"))
    size = F.least(F.col("nth") + 1, F.lit(w + 1))
    return upto.join(older, ["arm", "nth"], "left").select(
        "arm",
        "done",
        ((F.col("before") + F.col("accept") - F.coalesce("cut", F.lit(0.0))) / size).alias("smooth"),
    )


# ---- step logs -------------------------------------------------------------------------------------------------


def first_per_step(log: DataFrame, key: list[str], order: str) -> DataFrame:
    """First record per step and how many later records repeat it."""
    others = [c for c in log.columns if c not in key and c != order]
    kept = log.groupBy(*key).agg(F.min(F.struct(order, *others)).alias("f"), (F.count("*") - 1).alias("duplicates"))
    return kept.select(*key, *[F.col(f"f.{c}").alias(c) for c in [order, *others]], "duplicates")


def missing_steps(log: DataFrame, run: str, step: str, steps_per_slice: int = 100_000) -> DataFrame:
    """Steps absent between a run's first and last; only the gaps are spelled out."""
    distinct = log.select(run, step).distinct()
    slices = F.floor(F.col(step) / steps_per_slice)
    before = previous_in_slices(distinct, [run], step, slices, step, "__prev")
    gaps = before.filter(F.col(step) - F.col("__prev") > 1)
    return gaps.select(run, F.explode(F.sequence(F.col("__prev") + 1, F.col(step) - 1)).alias(step))
