"""Result trees and counter scrapes to the acceptance and speed-up report."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import sets as X
from ..sources import readers as R


def speedup_report(spark: SparkSession, root: str, pattern: str, status_pattern: str) -> DataFrame:
    """Drafter against its own plain arm per benchmark and level, from the runs that ended well.

    Two successful runs for one cell stop the report.
    """
    runs = R.read_results(spark, root, pattern, ["output_tokens", "wall_s"])
    good = R.successful_runs(spark, runs, root, status_pattern)
    X.assert_unique(good, ["arm", "benchmark", "level", "seed"])
    results = good.select(
        "benchmark", "arm", "level", F.col("output_tokens").alias("tokens"), F.col("wall_s").alias("seconds")
    )
    pooled = E.throughput(results, ["benchmark", "arm", "level"]).drop("tokens_per_s")
    return E.speedup(J.pair_arms(pooled))


def acceptance_from_scrapes(before: DataFrame, after: DataFrame, by: str = "subset", positions: int = 0) -> DataFrame:
    """Counters of two scrapes (``<by>, name, position, total``) to pooled acceptance per subset, with the rates of the
    first ``positions`` draft positions."""
    keys = [by, "name", "position"]
    b = before.withColumnRenamed("total", "b")
    same = [after[k].eqNullSafe(b[k]) for k in keys]
    grown = after.join(b, same, "left").select(
        *[after[k] for k in keys], (F.col("total") - F.coalesce("b", F.lit(0.0))).alias("d")
    )
    name = F.regexp_replace("name", r"^\w+:", "")

    def counter(label: str):
        return F.sum(F.when((name == label) & F.col("position").isNull(), F.col("d")).otherwise(0.0))

    def at(position: int):
        here = (name == "spec_decode_num_accepted_tokens_per_pos") & (F.col("position") == position)
        return F.sum(F.when(here, F.col("d")).otherwise(0.0))

    counters = grown.groupBy(by).agg(
        counter("spec_decode_num_drafts").alias("drafts"),
        counter("spec_decode_num_draft_tokens").alias("draft_tokens"),
        counter("spec_decode_num_accepted_tokens").alias("accepted_tokens"),
        *[at(i).alias(f"pos_{i}") for i in range(positions)],
    )
    return E.acceptance(counters, by, positions)
