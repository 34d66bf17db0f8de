"""Unions, differences, intersections and two-way mixes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, settle
from .ordering import prefix_select_all
from .selection import require_rows


def assert_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; stops when a key occurs twice."""
    twice = duplicate_keys(rows, keys).limit(3).collect()
    if twice:
        raise ValueError(f"duplicate keys, e.g. {[tuple(r)[: len(keys)] for r in twice]}")
    return rows


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def union_sources(named: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """Union by name with a ``source`` label; ids are prefixed by the label so they stay disjoint."""
    parts = [
        df.withColumn(key, F.concat(F.lit(name + ":"), F.col(key).cast("string"))).withColumn("source", F.lit(name))
        for name, df in named.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def gather_parts(old: DataFrame, new: DataFrame, offset: int = 1000, row: str = "row", part: str = "part") -> DataFrame:
    """Two part sets in one, the second renumbered by ``offset``; a row in both stops the job."""
    shared = old.select(row).intersect(new.select(row)).limit(3).collect()
    if shared:
        raise ValueError(f"rows in both sets, e.g. {[r[0] for r in shared]}")
    return old.unionByName(new.withColumn(part, F.col(part) + offset))


def remove_source(rows: DataFrame, removed: DataFrame, key: str = "id") -> DataFrame:
    return lookup_join(rows, removed.select(key), [key], "left_anti")


def overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many distinct keys both sides hold."""
    return a.select(*keys).intersect(b.select(*keys)).agg(F.count("*").alias("shared"))


def require_no_overlap(a: DataFrame, b: DataFrame, keys: list[str]) -> int:
    n = overlap(a, b, keys).first().shared
    if n:
        raise ValueError(f"{n} keys are on both sides")
    return n


def max_over_scans(*scans: DataFrame, key: str = "item_id", value: str = "best") -> DataFrame:
    stacked = reduce(lambda a, b: a.unionByName(b), [s.select(key, value) for s in scans])
    return stacked.groupBy(key).agg(F.max(value).alias(value))


def mix_datasets(
    original: DataFrame, regenerated: DataFrame, n_regenerated: int, val_original: int, val_regenerated: int, seed: int
) -> DataFrame:
    """Original and regenerated rows in one labelled set, validation quotas taken out first.

    Both inputs have ``id`` (the prompt's row). A regenerated row whose prompt is anywhere in the original part is skipped,
    so no prompt is on both sides. Too few rows for the part or a quota stop the job. Returns the rows whole with ``part``
    and ``split``; a column of one input only is null in the other. Ids alone are chosen and moved; rows meet their labels
    where they are.
    """
    clean = settle(regenerated.select("id").join(original.select("id"), "id", "left_anti"), "regenerated")
    chosen = settle(prefix_select_all(clean, ["id"], F.lit(1), n_regenerated + val_regenerated, seed), "chosen")
    require_rows(chosen, n_regenerated + val_regenerated, "regenerated part")
    labelled = []
    for part, rows, ids, quota in (
        ("original", original, original.select("id"), val_original),
        ("regenerated", lookup_join(regenerated, chosen, ["id"], "left_semi", settled=True), chosen, val_regenerated),
    ):
        held = settle(prefix_select_all(ids, ["id"], F.lit(1), quota, f"{seed}:{part}"), "held")
        require_rows(held, quota, f"validation of the {part} part")
        marked = lookup_join(rows, held.withColumn("split", F.lit("val")), ["id"], "left")
        labelled.append(marked.withColumns({"split": F.coalesce("split", F.lit("train")), "part": F.lit(part)}))
    return labelled[0].unionByName(labelled[1], allowMissingColumns=True)


def mix_report(mixed: DataFrame, n: str = "n") -> DataFrame:
    """Per part and in total (part null): rows and tokens of both splits, and the ratio that makes a trainer, which truncates
    rows times ratio, train on just the training rows."""
    train = F.col("split") == "train"
    counts = mixed.rollup("part").agg(
        F.count_if(train).alias("train_rows"),
        F.count_if(~train).alias("val_rows"),
        F.coalesce(F.sum(F.when(train, F.col(n))), F.lit(0)).alias("train_tokens"),
        F.coalesce(F.sum(F.when(~train, F.col(n))), F.lit(0)).alias("val_tokens"),
    )
    return counts.withColumn("train_ratio", (F.col("train_rows") + 0.5) / (F.col("train_rows") + F.col("val_rows")))


def share_quota(rows: DataFrame, by: str, share: float) -> DataFrame:
    """``by, n_rows, quota``: a share of every group's rows, halves rounded to even."""
    return rows.groupBy(by).agg(F.count("*").alias("n_rows")).withColumn("quota", F.bround(F.col("n_rows") * F.lit(share)).cast("bigint"))
