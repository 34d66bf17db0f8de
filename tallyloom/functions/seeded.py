"""Seeded, partition-independent order, fraction and bucket of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of the order key that name a slice; 16**4 slices per group.
SLICE_DIGITS = 4


def order_key(seed: int | str, *cols: Column | str) -> Column:
    """md5 of ``seed:col:col``; sorting by it is a reproducible shuffle."""
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def hex_int(hex_text: Column) -> Column:
    return F.conv(hex_text, 16, 10).cast("bigint")


def key_fraction(key: Column) -> Column:
    """Number in [0, 1) from the first 13 hex digits of a hash."""
    return hex_int(F.substring(key, 1, 13)).cast("double") / F.lit(float(16**13))


def key_bucket(key: Column, n: int | Column) -> Column:
    """Bucket number from the first 8 hex digits of a hash."""
    return F.pmod(hex_int(F.substring(key, 1, 8)), F.lit(n) if isinstance(n, int) else n)


def slice_of(key: Column) -> Column:
    return F.substring(key, 1, SLICE_DIGITS)
