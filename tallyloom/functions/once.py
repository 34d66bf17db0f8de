"""Evaluate a costly expression once.

The optimizer may copy a column's expression into every place that uses it, also into lambdas that run per array
element. ``let`` binds a value inside an expression; ``pinned`` computes columns once per row for all later steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(rows: DataFrame, columns: dict[str, Column], keep: list[str]) -> DataFrame:
    """``keep`` columns and the computed ones; nothing is copied past this step and nothing is shuffled."""
    made = F.struct(*[c.alias(name) for name, c in columns.items()])
    return rows.select(*keep, F.explode(F.array(made)).alias("__made")).select(
        *keep, *[F.col(f"__made.{name}").alias(name) for name in columns]
    )
