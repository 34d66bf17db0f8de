"""Joins by key, by range and by fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join

def keep_selected(rows: DataFrame, selected: DataFrame, key: str = "id") -> DataFrame:
    return lookup_join(rows, selected.select(key), [key], "left_semi")


def exclude_keys(rows: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose composite key is not among the held-out keys (a null key never matches)."""
    return lookup_join(rows, held.select(*keys), keys, "left_anti")


resume_against = exclude_keys


def attach_source(texts: DataFrame, chats: DataFrame, key: str = "source_id") -> DataFrame:
    return texts.join(chats, key)


def _bins(ranges: DataFrame, lo: str, hi: str) -> tuple[DataFrame, int]:
    """Every range copied to the fixed-width bins it touches; the width is the mean range length, so at most two copies
    per range on average."""
    mean = ranges.agg(F.avg(F.col(hi) - F.col(lo)).alias("m")).first().m
    width = max(1, int(mean or 1))
    binned = ranges.filter(F.col(hi) > F.col(lo)).withColumn(
        "__bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor((F.col(hi) - 1) / width)))
    )
    return binned, width


def exclude_ranges(rows: DataFrame, ranges: DataFrame, position: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Rows whose position lies in none of the half-open ranges; an equi-join on bins, not a nested loop."""
    binned, width = _bins(ranges, lo, hi)
    keyed = rows.withColumn("__b", F.floor(F.col(position) / width))
    inside = (F.col("__b") == F.col("__bin")) & (F.col(position) >= F.col(lo)) & (F.col(position) < F.col(hi))
    return keyed.join(binned.select("__bin", lo, hi), inside, "left_anti").drop("__b")


def locate_rows(index: DataFrame, shards: DataFrame, position: str) -> DataFrame:
    """Global position to shard and local position. ``shards``: ``shard, lo, hi``."""
    binned, width = _bins(shards, "lo", "hi")
    keyed = index.withColumn("__b", F.floor(F.col(position) / width))
    inside = (F.col("__b") == F.col("__bin")) & (F.col(position) >= F.col("lo")) & (F.col(position) < F.col("hi"))
    return (
        keyed.join(binned, inside)
        .withColumn("local_row", F.col(position) - F.col("lo"))
        .drop("__b", "__bin", "lo", "hi")
    )


def in_vocab(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """Flag ``known`` for every token row; the vocabulary has one row per token."""
    marked = vocab.select("token").distinct().withColumn("__v", F.lit(1))
    return lookup_join(tokens, marked, ["token"], "left").withColumn("known", F.col("__v").isNotNull()).drop("__v")


def pair_arms(results: DataFrame, prefix: str = "plain-") -> DataFrame:
    """Every drafter arm beside its own plain arm at the same benchmark and level.

    ``results``: ``benchmark, arm, level, tokens, seconds``; there is one row per key.
    """
    is_plain = F.startswith("arm", F.lit(prefix))
    plain = results.filter(is_plain).select(
        "benchmark",
        "level",
        F.substring(F.col("arm"), len(prefix) + 1, 2**30).alias("arm"),
        F.col("tokens").alias("plain_tokens"),
        F.col("seconds").alias("plain_seconds"),
    )
    return results.filter(~is_plain).join(plain, ["benchmark", "arm", "level"])


def pair_completions(prompts: DataFrame, completions: DataFrame, keys: list[str]) -> DataFrame:
    return prompts.join(completions, keys)


def reconcile(manifest: DataFrame, data: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """Keys whose counters differ between manifest and data, or that only one of them has."""
    m = manifest.select(*keys, *[F.col(c).alias(f"manifest_{c}") for c in counts])
    d = data.select(*keys, *[F.col(c).alias(f"data_{c}") for c in counts])
    differs = F.lit(False)
    for c in counts:
        differs = differs | ~F.col(f"manifest_{c}").eqNullSafe(F.col(f"data_{c}"))
    return m.join(d, keys, "full").filter(differs)


def fingerprint(tokens: str = "tokens", head: int = 40, tail: int = 8) -> Column:
    """Length, first and last tokens of a row as one key."""
    last = F.when(
        F.size(tokens) > 0, F.slice(tokens, -F.least(F.lit(tail), F.size(tokens)), F.lit(tail))
    ).otherwise(F.col(tokens))
    return F.concat_ws(
        "|", F.size(tokens).cast("string"), F.array_join(F.slice(tokens, 1, head), " "), F.array_join(last, " ")
    )


def fingerprint_match(a: DataFrame, b: DataFrame, tokens: str = "tokens", keep: bool = True) -> DataFrame:
    """Rows of ``a`` whose fingerprint occurs in ``b`` (or does not, with ``keep=False``)."""
    keys = b.select(fingerprint(tokens).alias("__f")).distinct()
    return a.withColumn("__f", fingerprint(tokens)).join(keys, "__f", "left_semi" if keep else "left_anti").drop("__f")


def drop_flagged(prompts: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    return exclude_keys(prompts, flagged, keys)
