"""Evaluation problems found in training prompts, over several datasets, removed from the prompt sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import contamination as N
from ..operators import joins as J
from ..operators import sets as X
from ..session import settle


def decontaminate(problems: DataFrame, datasets: dict[str, DataFrame], least: float = 0.5, n: int = N.GRAM) -> DataFrame:
    """Problems (``item_id, tokens``) that no dataset contains. ``datasets``: ``id, tokens, mask`` each.

    A problem is found when one training row holds at least ``least`` of its n-grams. Problems too short to test stay.
    """
    totals = N.problem_totals(N.problem_grams(problems, n))
    scans = [settle(N.contamination(N.ngram_hits(rows, problems, n), totals), name) for name, rows in datasets.items()]
    return J.drop_flagged(problems, N.flagged_items(X.max_over_scans(*scans), least), ["item_id"])


def decontamination_counts(problems: DataFrame, kept: DataFrame, by: str) -> DataFrame:
    """Per set: problems kept and dropped."""
    marked = problems.join(kept.select("item_id").withColumn("kept", F.lit(1)), "item_id", "left")
    return marked.groupBy(by).agg(
        F.count("kept").alias("rows_kept"), (F.count("*") - F.count("kept")).alias("rows_dropped")
    )
