"""Ordered totals and prefixes that never put a whole group into one task.

Rows are placed into order-preserving slices. Slice totals are few and are summed by a window; rows are only ordered
inside their slice. With the seeded key a slice holds about 1/65536 of its group, however large the group is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.seeded import order_key, slice_of
from ..session import lookup_join, settle


def total_before(
    rows: DataFrame, group: list[str], order: list[str], slice_by: Column, value: Column | str, out: str
) -> DataFrame:
    """Add ``out``: the total of ``value`` over the rows that precede a row in its group.

    ``slice_by`` must never decrease along ``order``.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [*group, "__slice"]
    sliced = in_slices(rows, group, slice_by).withColumn("__value", value)
    starts = _slice_starts(sliced, group).select(*keys, "__start")
    inside = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return sliced.join(starts, keys).withColumn(
        out, F.col("__start") + F.coalesce(F.sum("__value").over(inside), F.lit(0))
    ).drop("__slice", "__value", "__start")


def in_slices(rows: DataFrame, group: list[str], slice_by: Column) -> DataFrame:
    """Rows with their ``__slice``, failing on a null group or order: an equi-join would silently drop such rows."""

    def present(value: Column, name: str) -> Column:
        return F.coalesce(value, F.raise_error(F.lit(f"null in {name}")))

    checked = {name: present(F.col(name), name) for name in group}
    return rows.withColumn("__slice", present(slice_by, "the order")).withColumns(checked)


def _slice_starts(sliced: DataFrame, group: list[str]) -> DataFrame:
    totals = sliced.groupBy(*group, "__slice").agg(F.sum("__value").alias("__total"))
    earlier = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    return totals.withColumn("__start", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))


def seeded_index(rows: DataFrame, seed: int, key: list[str], out: str = "row_index") -> DataFrame:
    """Dense 0-based position of every row in the seeded order."""
    keyed = rows.withColumn("__h", order_key(seed, *key))
    return total_before(
        keyed, [], ["__h", *key], slice_of(F.col("__h")), F.lit(1).cast("bigint"), out
    ).drop("__h")


def prefix_select(
    rows: DataFrame,
    targets: DataFrame,
    group: list[str],
    key: list[str],
    weight: Column | str,
    seed: int | str,
    target: str = "target",
) -> DataFrame:
    """Per group, rows in seeded order while the total before the row is below the group's target.

    ``targets`` has one row per group. The last row taken may overshoot. Weights must be positive.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    keyed = rows.withColumn("__h", order_key(seed, *group, *key)).withColumn("__value", weight)
    sliced = in_slices(keyed, group, slice_of(F.col("__h")))
    goal = targets.select(*group, F.col(target).alias("__target"))
    starts = _slice_starts(sliced, group)
    cut = (
        goal.join(starts, group, "left")
        .groupBy(*group, "__target")
        .agg(
            F.min(
                F.when(
                    F.col("__start") + F.col("__total") > F.col("__target"), F.struct("__slice", "__start")
                )
            ).alias("__cut")
        )
        .select(*group, "__target", F.col("__cut.__slice").alias("__edge"), F.col("__cut.__start").alias("__edge_start"))
    )
    marked = lookup_join(sliced, cut, group)
    helpers = ["__h", "__slice", "__value", "__target", "__edge", "__edge_start"]
    below = marked.filter(F.col("__edge").isNull() | (F.col("__slice") < F.col("__edge")))
    inside = W.partitionBy(*group).orderBy("__h", *key).rowsBetween(W.unboundedPreceding, -1)
    edge = (
        marked.filter(F.col("__slice") == F.col("__edge"))
        .withColumn("__before", F.col("__edge_start") + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .filter(F.col("__before") < F.col("__target"))
        .drop("__before")
    )
    return below.unionByName(edge).drop(*helpers)


def prefix_select_all(
    rows: DataFrame, key: list[str], weight: Column | str, target: float, seed: int | str
) -> DataFrame:
    """``prefix_select`` over all rows as one group.

    Slice totals (at most 65536) give the one slice in which the target falls; only that slice's rows are ordered.
    """
    weight = F.col(weight) if isinstance(weight, str) else weight
    sliced = (
        rows.withColumn("__h", order_key(seed, *key))
        .withColumn("__slice", slice_of(F.col("__h")))
        .withColumn("__value", weight)
    )
    over = F.col("__start") + F.col("__total") > target
    cut = _slice_starts(sliced, []).agg(F.min(F.when(over, F.struct("__slice", "__start"))).alias("c")).first().c
    helpers = ["__h", "__slice", "__value"]
    if cut is None:
        return rows
    below = sliced.filter(F.col("__slice") < cut["__slice"])
    inside = W.partitionBy("__slice").orderBy("__h", *key).rowsBetween(W.unboundedPreceding, -1)
    edge = (
        sliced.filter(F.col("__slice") == cut["__slice"])
        .withColumn("__before", F.lit(cut["__start"]) + F.coalesce(F.sum("__value").over(inside), F.lit(0)))
        .filter(F.col("__before") < target)
        .drop("__before")
    )
    return below.unionByName(edge).drop(*helpers)


def key_at(rows: DataFrame, seed: int, key: list[str], place: Callable[[int], int]):
    """The order key and key columns of the row at a place of the seeded order, or None beyond the last.

    ``place`` gets the number of rows. Counts of the order's slices tell the one slice that holds the place; only the keys of
    that slice are ordered, about 1/65536 of them.
    """
    keyed = rows.select(*key).withColumn("__h", order_key(seed, *key)).withColumn("__slice", slice_of(F.col("__h")))
    sizes = settle(keyed.groupBy("__slice").agg(F.count("*").alias("__total")), "slices")
    nth = place(sizes.agg(F.coalesce(F.sum("__total"), F.lit(0)).alias("n")).first().n)
    starts = sizes.withColumn("__start", F.coalesce(F.sum("__total").over(W.orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cut = starts.filter(F.col("__start") + F.col("__total") > nth).orderBy("__slice").first()
    if cut is None or nth < 0:
        return None
    inside = keyed.filter(F.col("__slice") == cut["__slice"]).select("__h", *key)
    return inside.orderBy("__h", *key).offset(nth - cut["__start"]).limit(1).first()


def placed_by_id(rows: DataFrame) -> DataFrame:
    """Rows placed by id, over as many partitions as the session's shuffles have.

    The number is given, so the adaptive planner does not merge small partitions whose exploded rows are much larger.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "id")


def per_group_limit(rows: DataFrame, group: list[str], order: list[Column | str], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group; Spark trims each task to ``k`` rows per group before the shuffle."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)

