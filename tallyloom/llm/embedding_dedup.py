"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, and exact cosine.

Rotations are learned on a bounded sample (principal directions, then alternating binary codes and the rotation nearest to
them), so that every bit splits the vectors evenly. The bits of as many learned rotations as give ``TABLES`` tables are cut into parts of
``PART_BITS``; each part is the key of one table. A vector stands in its own bucket of every table and visits the buckets
that differ in one of the ``FLIPS`` bits its projections are least sure of. Vectors that meet in a bucket are compared by
cosine in double precision with the original vectors, block by block; a pair that could meet in several tables or in both
directions counts only in the first. No list of pairs is made: a task returns the number of links of each vector and, for
the components, links that span what it found.

Equal vectors are compared once, as a class. A bucket of many vectors is dealt into blocks, and each pair of blocks is a task
of its own. Vectors of different lengths are never compared; a length with at most a block of classes is one bucket without
an index, and all such lengths are one job. Vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing and
are kept. Rows that share an id and a vector are vectors of their own; components are named by ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup_join, settle
from .common import components, deal_blocks

LEAST_COSINE = 0.9
SAMPLE = 10_000
ITERATIONS = 20
# Tables that an index has at least, whatever the length of its vectors; a rotation gives one per part of its bits.
TABLES = 8
ROTATION_BITS = 64
PART_BITS = 16
FLIPS = 4
# Members of a bucket that one block may hold, rows and components of a task's group, and cells of a block of cosines.
BLOCK = 2048
GROUP_ROWS = 40_000
GROUP_CELLS = 64 * GROUP_ROWS
CELLS = 4_000_000


@dataclass
class Quantiser:
    mean: np.ndarray
    rotations: list[np.ndarray]

    def codes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of the codes, and masks of the bits that are flipped for visits, both vectors by tables."""
        parts, flips = [], []
        weight = (1 << np.arange(PART_BITS)).astype(np.int64)
        for r in self.rotations:
            z = (x - self.mean) @ r
            for a in range(0, z.shape[1], PART_BITS):
                part = z[:, a : a + PART_BITS]
                w = weight[: part.shape[1]]
                parts.append((part > 0) @ w)
                unsure = np.argsort(np.abs(part), axis=1, kind="stable")[:, :FLIPS]
                flips.append(w[unsure].sum(1))
        return np.stack(parts, 1), np.stack(flips, 1)


def learn(sample: np.ndarray, seed: int = 7) -> Quantiser:
    """Iterative quantisation of unit vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    x = sample - mean
    _, _, directions = np.linalg.svd(x, full_matrices=False)
    bits = min(ROTATION_BITS, sample.shape[1], len(directions))
    bits -= bits % PART_BITS if bits > PART_BITS else 0
    v = x @ directions[:bits].T
    rotations = []
    for _ in range(-(-TABLES // -(-bits // PART_BITS))):
        r, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
        for _ in range(ITERATIONS):
            b = np.where(v @ r > 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(b.T @ v)
            r = (u @ w).T
        rotations.append(directions[:bits].T @ r)
    return Quantiser(mean, rotations)


def _matrix(column: pa.Array) -> np.ndarray:
    dims = len(column[0]) if len(column) else 0
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dims)


def unit(x: np.ndarray) -> np.ndarray:
    scale = np.abs(x).max(1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def valid(vector) -> F.Column:
    """No nulls, nothing that is not finite, and not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False)) & F.coalesce(F.exists(vector, lambda v: v != 0), F.lit(False))


def learned(classes: DataFrame, dims: int, most: int = SAMPLE) -> Quantiser:
    """A quantiser from the classes of one length with the smallest hashes; a bounded sample."""
    same = classes.where(F.size("embedding") == dims)
    # Hashes are ordered first, so only the chosen vectors travel.
    chosen = same.select("cls").orderBy("cls").limit(most)
    rows = same.select("cls", "embedding").join(F.broadcast(chosen), "cls").select("embedding").toArrow()
    return learn(unit(_matrix(rows["embedding"].combine_chunks())))


def visits(spark: SparkSession, classes: DataFrame, quantiser: Quantiser) -> DataFrame:
    """Rows of every vector for its own buckets and the ones it visits, with its code and its vector."""
    sent = spark.sparkContext.broadcast(quantiser)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                parts, flips = sent.value.codes(unit(_matrix(part.column(3))))
                bits = 1 << np.arange(PART_BITS)
                rows, tables = parts.shape
                stay = np.repeat(np.arange(rows), tables), np.tile(np.arange(tables), rows)
                go = np.nonzero((flips[:, :, None] & bits) > 0)
                row = np.concatenate([stay[0], go[0]])
                table = np.concatenate([stay[1], go[1]])
                bucket = parts[row, table]
                bucket[len(stay[0]) :] ^= bits[go[2]]
                at = pa.array(row)
                columns = [pa.array(table.astype(np.int32)), pa.array(bucket.astype(np.int32))]
                columns += [c.take(at) for c in part.columns]
                columns += [_lists(x, row) for x in (parts, flips)]
                yield pa.RecordBatch.from_arrays(columns, names=["table", "bucket", "cls", "id", "copies", "embedding", "parts", "flips"])

    kind = classes.schema["embedding"].dataType.simpleString()
    id_kind = classes.schema["id"].dataType.simpleString()
    return classes.select("cls", "id", "copies", "embedding").mapInArrow(
        work, f"`table` int, bucket int, cls bigint, id {id_kind}, copies bigint, embedding {kind}, parts array<int>, flips array<int>"
    )


def _lists(x: np.ndarray, row: np.ndarray) -> pa.Array:
    flat = x[row].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * x.shape[1]), pa.array(flat.ravel()))


def _first_meeting(ours, theirs, our_flips, their_flips, table: int) -> np.ndarray:
    """Whether two vectors meet in this table, in the bucket of the first, and in no earlier place."""
    differ = ours ^ theirs
    single = (differ & (differ - 1)) == 0
    there = (differ == 0) | (single & ((differ & (our_flips | their_flips)) != 0))
    before = there[..., :table].any(-1)
    # Both may visit each other: the pair belongs to the bucket of the smaller code.
    mutual = (differ[..., table] & our_flips[..., table]) != 0
    return ~before & ((differ[..., table] == 0) | ~mutual | (ours[..., table] < theirs[..., table]))


def _compare(resident: np.ndarray, other: np.ndarray, x, parts, flips, table: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of residents and others of one bucket, by blocks."""
    for a in range(0, len(resident), 512):
        r = resident[a : a + 512]
        step = max(1, CELLS // (len(r) * 8))
        for b in range(0, len(other), step):
            o = other[b : b + step]
            i, j = np.nonzero(x[r] @ x[o].T >= LEAST_COSINE)
            if len(i):
                i, j = r[i], o[j]
                first = _first_meeting(parts[i], parts[j], flips[i], flips[j], table)
                yield i[first], j[first]


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray) -> np.ndarray:
    """The member of smallest rank that links connect each member to."""
    root = np.arange(n)
    a = np.concatenate([p[0] for p in pairs])
    b = np.concatenate([p[1] for p in pairs])
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        by_rank = np.empty(n, np.int64)
        by_rank[rank] = np.arange(n)
        new = np.minimum(new, new[by_rank[new]])
        if (new == label).all():
            root = by_rank[label]
            return root
        label = new


def links(rows: DataFrame) -> DataFrame:
    """``cls, id, n, root``: per bucket and vector, the links found there and an id that they connect it to."""
    id_kind = rows.schema["id"].dataType.simpleString()
    dealt = deal_blocks(rows, ["table", "bucket"], "cls", BLOCK)
    total = dealt.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.size("embedding")), F.lit(0)).alias("cells")).first()
    groups = max(1, -(-total["rows"] // GROUP_ROWS), -(-total["cells"] // GROUP_CELLS))
    keyed = dealt.withColumn("__g", F.pmod(F.xxhash64("table", "bucket", "low", "high"), F.lit(groups)))

    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([(c, "ascending") for c in ("table", "bucket", "low", "high", "cls")])
        name = {c: table[c].combine_chunks() for c in table.schema.names}
        t, bucket, low, high, own = (name[c].to_numpy() for c in ("table", "bucket", "low", "high", "own"))
        key = np.stack([t, bucket, low, high], 1)
        ends = np.append(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, len(key))
        starts = np.append(0, ends[:-1])
        tables = len(name["parts"][0]) if len(key) else 0
        parts = name["parts"].values.to_numpy().reshape(-1, tables)
        flips = name["flips"].values.to_numpy().reshape(-1, tables)
        resident = parts[np.arange(len(t)), t] == bucket
        busy = (ends - starts > 1) & (np.add.reduceat(resident, starts) > 0)
        cls, copies = name["cls"].to_numpy(), name["copies"].to_numpy()
        values = name["embedding"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        cuts = np.append(0, np.cumsum(pc.list_value_length(name["embedding"]).to_numpy()))
        found_i, found_j = [], []
        for s, e in zip(starts[busy].tolist(), ends[busy].tolist(), strict=True):
            # All vectors of a bucket have one length.
            x = unit(values[cuts[s] : cuts[e]].reshape(e - s, -1))
            for i, j in _compare(np.flatnonzero(resident[s:e]), np.arange(e - s), x, parts[s:e], flips[s:e], int(t[s])):
                i, j = i + s, j + s
                # Two residents come in both orders: keep one. Pairs inside a block belong to that block's own task.
                fine = (cls[i] != cls[j]) & ~(resident[j] & (cls[i] > cls[j]))
                fine &= (own[i] != own[j]) if low[s] != high[s] else True
                found_i.append(i[fine])
                found_j.append(j[fine])
        if not found_i or not sum(map(len, found_i)):
            return pa.table({"cls": pa.array([], pa.int64()), "id": pa.array([], name["id"].type), "n": pa.array([], pa.int64()), "root": pa.array([], name["id"].type)})
        i, j = np.concatenate(found_i), np.concatenate(found_j)
        n = np.zeros(len(cls), np.int64)
        np.add.at(n, i, copies[j])
        np.add.at(n, j, copies[i])
        some = np.flatnonzero(n)
        short = np.full(len(cls), -1)
        short[some] = np.arange(len(some))
        ids = name["id"].take(pa.array(some))
        order = np.argsort(ids.to_numpy(), kind="stable")
        rank = np.empty(len(some), np.int64)
        rank[order] = np.arange(len(some))
        root = _roots(len(some), [(short[i], short[j])], rank)
        return pa.table({"cls": cls[some], "id": ids, "n": n[some], "root": ids.take(pa.array(root))})

    return keyed.groupBy("__g").applyInArrow(work, f"cls bigint, id {id_kind}, n bigint, root {id_kind}")


def near_duplicates(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``vectors`` (``vec_id, embedding``)."""
    fine = valid(F.col("embedding")) & F.col("vec_id").isNotNull()
    rows = vectors.select("vec_id", "embedding", F.coalesce(fine, F.lit(False)).alias("fine"))
    # Equal vectors are one class; its number is the hash of the vector, its id the smallest.
    good = rows.where("fine").select("vec_id", F.xxhash64(F.transform("embedding", lambda v: v + F.lit(0.0))).alias("cls"), "embedding")
    classes = settle(
        good.groupBy("cls").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")), "classes"
    )
    sized = classes.withColumn("dims", F.size("embedding"))
    lengths = settle(sized.groupBy("dims").agg(F.count("*").alias("n")).where("n > 1"), "lengths")
    # A length of at most one block is compared as a single bucket, all such lengths at once.
    few = lookup_join(sized, lengths.where(F.col("n") <= BLOCK).select("dims"), ["dims"], "left_semi")
    zero = F.array(F.lit(0))
    single = few.select(
        F.lit(0).alias("table"), F.col("dims").alias("bucket"), "cls", "id", "copies", "embedding", F.array("dims").alias("parts"), zero.alias("flips")
    )
    found = links(settle(single, "single"))
    # One row per length that fills more than a block.
    for r in lengths.where(F.col("n") > BLOCK).orderBy("dims").collect():
        here = classes.where(F.size("embedding") == r["dims"])
        found = found.unionAll(links(settle(visits(spark, here, learned(classes, r["dims"])), "visits")))
    found = settle(found, "found")
    spans = found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    named = components(classes.select("id").distinct(), spans)
    counts = found.groupBy("cls").agg(F.sum("n").alias("n"))
    verdict = (
        classes.select("cls", "id", "copies").join(counts, "cls", "left").join(named, "id")
        .select("cls", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    )
    linked = lookup_join(good.select("vec_id", "cls"), verdict, ["cls"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~F.col("fine")).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
