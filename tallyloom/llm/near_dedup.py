"""MinHash near-duplicates: circulant MinHash, banding, and exact Jaccard verification.

Circulant MinHash needs two permutations: the first places a shingle on a circle of ``2**32`` places, the second ranks the
places, and coordinate ``k`` of a signature is the smallest rank after the places are shifted by ``k``. Bands of ``ROWS``
coordinates name buckets; texts that share a bucket are candidates, and links are confirmed on the full sets of shingles
(64-bit hashes).

Texts with equal sets are one class. Classes of a bucket are not compared in pairs: in each round every class is compared
with one representative of its buckets (the one it shares most with, preferring classes that stand in large buckets), and
links found make components. What is left are buckets that still hold several components. There the classes of different
components are compared by longer signatures, a block against a block per task, each pair in the first bucket it shares; only
pairs that may reach the threshold are returned and verified exactly. So no link between different components is lost for
lack of a comparison, and pairs inside a component are never listed.

Texts without words, and null texts, have the empty set, link with nothing and are kept. With fewer words than a shingle the
whole sequence is one. Rows without an id take part through their text; their component may be null. Repeated rows are one
class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import lookup_join, settle
from .common import components, deal_blocks, short_batches, slices, split_words, tidied

ROWS, BANDS = 6, 36
# Coordinates of the longer signatures, of which the lowest eight bits are kept, and how many deviations they may err.
LONG, DEVIATIONS = 1024, 4.5
# Rounds of comparison with representatives before the remaining buckets are compared block by block.
STAR_ROUNDS = 3
# Members of a block, rows of a task's group, characters that are hashed together.
BLOCK = 1024
GROUP_ROWS = 5_000
CHARS = 1_000_000


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """The sorted distinct hashes of every text's shingles of ``size`` words."""
    offsets, flat = split_words(texts)
    if not len(flat):
        return [np.zeros(0, np.uint64)] * len(texts)
    coded = flat.dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))[coded.indices.to_numpy()]
    mixed = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        mixed = _mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + h[k : k + len(mixed)] + np.uint64(size))
    out = []
    for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if e - s >= size:
            out.append(np.unique(mixed[s : e - size + 1]))
        elif e > s:
            one = np.zeros(1, np.uint64)
            for k in range(s, e):
                one = _mix64(one * np.uint64(0x9E3779B97F4A7C15) + h[k] + np.uint64(e - s))
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash of a set that is not empty."""
    place = (_mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(1, coordinates + 1, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(place), 256):
        x = place[a : a + 256, None] + shift
        # A permutation of the circle: every step can be undone.
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One number per band of signatures given as rows."""
    parts = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(ROWS):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def _as_lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def sketches(rows: DataFrame, size: int) -> DataFrame:
    """``id, t, n, cls, keys``: number of shingles, hash of their set, and the band keys (null for the empty set)."""
    kind = dict(rows.dtypes)["id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, CHARS):
                sets = shingle_sets(batch.column(2).slice(a, b - a), size)
                full = np.array([len(s) > 0 for s in sets])
                made = np.array([signature(s, ROWS * BANDS) for s in sets if len(s)], np.uint32).reshape(-1, ROWS * BANDS)
                where = np.where(full, np.cumsum(full) - 1, 0)
                keys = _as_lists(band_keys(made)).take(pa.array(where, mask=~full)) if full.any() else pa.nulls(len(sets), pa.list_(pa.int64()))
                cls = pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64(), mask=~full)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), cls, keys],
                    names=["id", "t", "n", "cls", "keys"],
                )
            pa.default_memory_pool().release_unused()

    return rows.select("id", "t", "text").mapInArrow(tidied(work), f"id {kind}, t bigint, n bigint, cls bigint, keys array<bigint>")


def sets_of(rows: DataFrame, classes: DataFrame, wanted: DataFrame, size: int, long: bool = False) -> DataFrame:
    """``cls`` and its ``shingles`` (or its long signature) for the classes in ``wanted``, made anew from the texts, written."""
    first = classes.join(wanted.select("cls").distinct(), "cls").select("cls", "id", "t")
    given = rows.select(F.col("id").alias("__id"), "t", "text")
    key = F.coalesce(F.col("__id").cast("string"), F.lit(""))
    found = lookup_join(
        given.select(F.xxhash64(key, "t").alias("__k"), "text"),
        first.select("cls", F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "t").alias("__k")).dropDuplicates(["__k"]),
        ["__k"],
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, CHARS):
                sets = shingle_sets(batch.column(1).slice(a, b - a), size)
                if long:
                    column = pa.array([(signature(s, LONG) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets], pa.binary())
                else:
                    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                    column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), column], names=["cls", "shingles"])
            pa.default_memory_pool().release_unused()

    made = found.select("cls", "text").mapInArrow(tidied(work), "cls bigint, shingles " + ("binary" if long else "array<bigint>"))
    # A class may stand for several equal rows.
    once = made.dropDuplicates(["cls"]) if long else made.groupBy("cls").agg(F.first("shingles").alias("shingles"))
    with short_batches(rows.sparkSession):
        return settle(once, "sets")


def verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs of classes ``a, b`` with ``100 * intersection >= percent * union``, written."""
    pairs = settle(pairs.select("a", "b").distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls")))
    sets = sets_of(rows, classes, wanted, size)
    both = (
        pairs.join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a")
        .join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
        .select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("shared"))
    )
    return settle(both.where(100 * F.col("shared") >= percent * (F.col("total") - F.col("shared"))).select("a", "b"), "links")


def star_pairs(buckets: DataFrame, percent: int) -> DataFrame:
    """For every class, the representative of another component that it shares most buckets with."""
    # The representative of a bucket is the class with the greatest weight; a plain maximum.
    top = buckets.groupBy("key").agg(F.max(F.struct("weight", (-F.col("cls")).alias("minus"), "comp", "n")).alias("r"))
    top = top.select("key", (-F.col("r.minus")).alias("rep"), F.col("r.comp").alias("rep_comp"), F.col("r.n").alias("rep_n"), F.col("r.weight").alias("rep_weight"))
    met = buckets.join(top, "key").where("comp <> rep_comp")
    fits = 100 * F.least("n", "rep_n") >= percent * F.greatest("n", "rep_n")
    shared = met.where(fits).groupBy("cls", "rep").agg(F.count("*").alias("shared"), F.max("rep_weight").alias("w"))
    best = shared.groupBy("cls").agg(F.max(F.struct("shared", "w", "rep"))["rep"].alias("rep"))
    return best.select(F.least("cls", "rep").alias("a"), F.greatest("cls", "rep").alias("b"))


def block_pairs(buckets: DataFrame, long: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes of different components that share a bucket and may reach the threshold by their long signatures."""
    rows = buckets.join(long, "cls")
    dealt = deal_blocks(rows, ["key"], "cls", BLOCK)
    total = dealt.count()
    groups = max(1, -(-total // GROUP_ROWS))
    keyed = dealt.withColumn("__g", F.pmod(F.xxhash64("key", "low", "high"), F.lit(groups)))
    j = percent / 100
    least = j - DEVIATIONS * float(np.sqrt(j * (1 - j) / LONG))

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("key", "low", "high", "cls")])
        col = {c: table[c].combine_chunks() for c in table.schema.names}
        key, low, high, own, cls, comp, n = (col[c].to_numpy() for c in ("key", "low", "high", "own", "cls", "comp", "n"))
        sig = np.frombuffer(b"".join(col["shingles"].to_pylist()), np.uint8).reshape(-1, LONG)
        keys = col["keys"].values.to_numpy().reshape(-1, BANDS)
        tile = np.stack([key, low, high], 1)
        ends = np.append(np.flatnonzero((tile[1:] != tile[:-1]).any(1)) + 1, len(tile))
        out: list[tuple[np.ndarray, np.ndarray]] = []
        start = 0
        for end in ends.tolist():
            for i in range(start, end - 1):
                o = np.arange(i + 1, end)
                o = o[(comp[o] != comp[i]) & ((own[o] != own[i]) | (low[i] == high[i]))]
                o = o[100 * np.minimum(n[o], n[i]) >= percent * np.maximum(n[o], n[i])]
                if len(o):
                    # The pair belongs to the first bucket that both stand in.
                    equal = keys[o] == keys[i]
                    o = o[keys[i][equal.argmax(1)] == key[i]]
                if len(o):
                    share = (sig[o] == sig[i]).mean(1)
                    o = o[(share - 1 / 256) / (1 - 1 / 256) >= least]
                    out.append((np.full(len(o), cls[i]), cls[o]))
            start = end
        a = np.concatenate([x for x, _ in out]) if out else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in out]) if out else np.zeros(0, np.int64)
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return keyed.groupBy("__g").applyInArrow(work, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, id_column: str, size: int, percent: int) -> DataFrame:
    """Rows with ``id, t, n_shingles, group, component_id``; ``t`` is the hash of the text, so ``(id, t)`` names a row.

    ``group`` is the component by classes, null for the empty set; ``component_id`` is the smallest id in it.
    """
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("text"))
    with short_batches(rows.sparkSession):
        made = settle(sketches(rows, size), "sketches")
    # One class per set of shingles; one of its rows stands for it when the set is needed again.
    classes = settle(
        made.where("cls IS NOT NULL").groupBy("cls").agg(
            F.min("id").alias("least"), F.min(F.struct(F.col("id"), F.col("t"))).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys")
        ).select("cls", "least", F.col("row.id").alias("id"), F.col("row.t").alias("t"), "n", "keys"),
        "classes",
    )
    keyed = classes.select("cls", "n", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    # The weight of a class is the number of others in its buckets: copies with few changes weigh most.
    buckets = settle(keyed.join(shared, "key").select("key", "cls", "n", "members"), "buckets")
    weights = buckets.groupBy("cls").agg(F.sum("members").alias("weight"))
    buckets = settle(buckets.drop("members").join(weights, "cls"), "buckets")
    nodes = buckets.select(F.col("cls").alias("id")).distinct()
    links = None
    labels = nodes.withColumn("component", F.col("id"))
    for step in range(STAR_ROUNDS + 1):
        labeled = buckets.join(labels.select(F.col("id").alias("cls"), F.col("component").alias("comp")), "cls")
        mixed = labeled.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("key")
        open_ = settle(labeled.join(mixed, "key"), "open")
        if open_.isEmpty():
            break
        if step < STAR_ROUNDS:
            pairs = star_pairs(open_, percent)
        else:
            long = sets_of(rows, classes, open_, size, long=True).join(classes.select("cls", "keys"), "cls")
            pairs = block_pairs(open_, settle(long, "long"), percent)
        found = verified(pairs, rows, classes, size, percent)
        links = found if links is None else links.unionAll(found)
        labels = settle(components(nodes, links), "labels")
    named = classes.join(labels.select(F.col("id").alias("cls"), F.col("component").alias("comp")), "cls", "left")
    named = named.select("cls", "least", F.coalesce("comp", "cls").alias("comp"))
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    verdict = lookup_join(named.select("cls", "comp"), smallest, ["comp"]).select("cls", F.col("comp").alias("group"), "component_id")
    linked = lookup_join(made.where("cls IS NOT NULL").select("id", "t", F.col("n").alias("n_shingles"), "cls"), verdict, ["cls"])
    alone = made.where("cls IS NULL").select(
        "id", "t", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("group"), F.col("id").alias("component_id")
    )
    return linked.select("id", "t", "n_shingles", "group", "component_id").unionByName(alone)


def one_of_each(documents: DataFrame, id_column: str, size: int, percent: int) -> DataFrame:
    """Of every group of near-duplicates, one row: the smallest by id and then by the text's hash; all its columns stay.

    Rows with the empty set of shingles are groups of their own. Of rows equal in id and text one stays, with columns of any.
    """
    name = F.xxhash64(F.coalesce(F.col(id_column).cast("string"), F.lit("")), F.xxhash64(F.coalesce("text", F.lit(""))))
    found = settle(near_duplicates(documents, id_column, size, percent).select("id", "t", "group"), "groups")
    key = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "t")
    chosen = found.where("`group` IS NOT NULL").groupBy("group").agg(F.min(F.struct("id", "t")).alias("r")).select("r.id", "r.t")
    chosen = chosen.select(key.alias("__k")).distinct()
    empty = found.where("`group` IS NULL").select(key.alias("__k")).distinct()
    repeated = found.join(empty.withColumnRenamed("__k", "__e"), key == F.col("__e"), "left_anti")
    repeated = repeated.groupBy(key.alias("__k")).agg(F.count("*").alias("__n")).where("__n > 1").select("__k")
    named = documents.withColumn("__k", name)
    kept = lookup_join(named, chosen.unionAll(empty), ["__k"], "left_semi")
    repeated = settle(repeated, "repeated")
    single = lookup_join(kept, repeated, ["__k"], "left_anti", settled=True)
    several = lookup_join(kept, repeated, ["__k"], "left_semi", settled=True).dropDuplicates(["__k"])
    return single.unionByName(several).select(*documents.columns)
