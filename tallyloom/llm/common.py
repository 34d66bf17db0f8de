"""Helpers of the language-model operators: text normalisation, Arrow words, documents, connected components."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup_join, settle

# The characters that separate words, and the letters that are lower-cased.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(column, F.lit(""))


def lower_ascii(column: Column) -> Column:
    return F.translate(column, UPPER, UPPER.lower())


def word_array(column: Column) -> Column:
    return F.regexp_extract_all(column, F.lit(WORD), F.lit(0))


def fold(column: Column) -> Column:
    """``crc32`` of a value written as text, modulo 5; null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8")) % 5


def split_words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, pa.Array]:
    """Words of every text: offsets into the flat array of words, and that array."""
    # A slice is copied first: case mapping reads the cast of a slice from the wrong place.
    plain = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    if lower:
        plain = pc.ascii_lower(plain)
    lists = pc.ascii_split_whitespace(plain)
    flat = lists.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    count = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=count[1:])
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return count[offsets - offsets[0]], flat.filter(full)


def joined(values: pa.Array) -> tuple[bytes, np.ndarray]:
    """The bytes of all values one after the other, and where they begin and end; a Python scalar for each would cost more."""
    raw = pa.concat_arrays([values]).cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    return data.to_pybytes()[offsets[0] : offsets[-1]] if data is not None and len(raw) else b"", offsets - offsets[0]


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it lasts, tasks hand at most so many rows at a time to Python; for steps that run inside it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def give_back(cycles: bool = True) -> None:
    """Free memory goes back to the system; a Python worker lives on after its task, beside the workers of later stages.

    Looking for cycles takes longer than a small group's work; what holds none need not.
    """
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def tidied(work: Callable) -> Callable:
    """A function over a task's batches that gives its memory back when the task ends."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def slices(sizes: np.ndarray, most: int):
    """Ranges of consecutive rows whose sizes sum to ``most`` at most; a larger row is a range of its own."""
    start, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def components(nodes: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """``id, component``: the smallest id that ``links`` (``a, b``) connect to each of ``nodes`` (``id``).

    Every round each linked node takes the smallest label among its neighbours (partial minima, so a hub is summed map-side)
    and then the label of its label. Only linked nodes take part; the labels are written to the shared folder each round.
    """
    both = settle(links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("id"), "label"), "labels")
    for _ in range(rounds):
        seen = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        nearer = labels.join(seen, "id").select("id", F.least("label", "near").alias("to"), F.col("label").alias("was"))
        jump = labels.select(F.col("id").alias("to"), F.col("label").alias("next"))
        after = settle(nearer.join(jump, "to").select("id", F.col("next").alias("label"), (F.col("next") != F.col("was")).alias("moved")), "labels")
        labels = after.select("id", "label")
        if after.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("links did not converge")
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def deal_blocks(rows: DataFrame, keys: list[str], member: str, block: int) -> DataFrame:
    """Rows dealt to pairs of blocks, so that all members of a key meet though no task holds a large key.

    A key of many members is cut into blocks by the hash of the member; each row goes to every pair of blocks that its own
    block is in (columns ``low, high``; ``own`` is its block). A key of at most ``block`` members is one pair, ``0, 0``.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > block)
    big = settle(sizes.select(*keys, F.ceil(F.col("__n") / block).cast("int").alias("__blocks")), "blocks")
    dealt = lookup_join(rows, big, keys, "left", settled=True).withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64(member), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    return dealt.withColumns({"low": F.least("own", "__with"), "high": F.greatest("own", "__with")}).drop("__blocks", "__with")
