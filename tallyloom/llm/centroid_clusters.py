"""Centroid clustering over losslessly dictionary-encoded dimension blocks.

Vectors are turned into integers and dealt into chunks of at most ``CHUNK`` vectors, inside the task that reads them. A chunk
holds, per block of neighbouring dimensions, the distinct subvectors of its vectors (the block's dictionary) and one code per
vector. A block starts as one dimension and is joined with its neighbour while at most one in ``REUSE`` of the chunk's vectors
is distinct there, so copies and coarse components share wide blocks and the others narrow ones. A round computes the exact
squared distance of every dictionary entry to every centroid once, adds the partial distances up by code, and sums the vectors
of a cluster from the counts of the codes. Vectors never move between tasks; a task gives one row per cluster and dimension.

Arithmetic is exact: machine integers where they suffice, Python integers otherwise. Only the centroids (``k`` vectors) reach
the driver.

Kept are vectors of the asked length without null or non-finite components, whose integers fit 63 bits (``|x| < 2**52``); all
others give no row. Ties between centroids go to the smaller number; between first centroids of equal hash (repeated ids) to
the smaller vector. Repeated rows each count. Fewer kept vectors than ``k`` give as many centroids; without any the result is
empty. A distance or sum beyond a long is given as the largest long. Further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import settle
from .common import short_batches

# Vectors of a chunk (65,536 at most, since codes have two bytes), and how many vectors must share a subvector on average before blocks are joined.
CHUNK = 8192
REUSE = 4
# Chunks handed to Python at a time.
CHUNKS_AT_ONCE = 4
LONGEST = 2**63 - 1
# Integers whose squared differences sum to a long over 64 dimensions.
PLAIN = 2**27


def integers(vector: Column, scale: int) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column, size: int, scale: int) -> Column:
    """Whether a vector has the asked length and only components that a long holds."""
    fits = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(2**62)), F.lit(False)))
    return F.coalesce((F.size(vector) == size) & fits, F.lit(False))


def blocks_of(rows: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(first dimension, distinct subvectors, code of every row)`` of every block of a chunk."""
    found = []
    for d in range(rows.shape[1]):
        values, codes = np.unique(rows[:, d], return_inverse=True)
        found.append((d, values[:, None], codes.astype(np.int64)))
    while len(found) > 1:
        joined, i = [], 0
        while i < len(found):
            if i + 1 < len(found):
                (start, left, a), (_, right, b) = found[i], found[i + 1]
                # No pair of blocks has fewer distinct subvectors than the larger of its two.
                if max(len(left), len(right)) * REUSE <= len(rows):
                    codes, pairs = pd.factorize(a * len(right) + b)
                    if len(pairs) * REUSE <= len(rows):
                        joined.append((start, np.hstack([left[pairs // len(right)], right[pairs % len(right)]]), codes))
                        i += 2
                        continue
            joined.append(found[i])
            i += 1
        if len(joined) == len(found):
            break
        found = joined
    return found


def encoder(id_type: pa.DataType, chunk_rows: int):
    """Rows ``id, v`` of a task as chunks: ids, the blocks' first dimensions, dictionaries and codes."""

    def chunk(ids: pa.Array, rows: np.ndarray) -> pa.RecordBatch:
        blocks = blocks_of(rows)
        wide = np.int64 if np.abs(rows).max() >= 2**31 else np.int32
        columns = {
            "ids": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
            "starts": pa.array([[start for start, _, _ in blocks]], pa.list_(pa.int32())),
            "wide": pa.array([wide is np.int64]),
            "dictionaries": pa.array([[sub.astype(wide).tobytes() for _, sub, _ in blocks]], pa.list_(pa.binary())),
            "codes": pa.array([[codes.astype(np.uint16).tobytes() for _, _, codes in blocks]], pa.list_(pa.binary())),
        }
        return pa.RecordBatch.from_pydict(columns)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0

        def flush() -> pa.RecordBatch:
            return chunk(pa.concat_arrays(ids).cast(id_type), np.concatenate(rows))

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, chunk_rows - held)
                ids.append(part.column("id"))
                rows.append(part.column("v").flatten().to_numpy().reshape(part.num_rows, -1))
                held, at = held + part.num_rows, at + part.num_rows
                if held == chunk_rows:
                    yield flush()
                    ids, rows, held = [], [], 0
        if held:
            yield flush()

    return encode


def chunks_in(batch: pa.RecordBatch, size: int):
    """Ids and blocks of every chunk of a batch."""
    for i in range(batch.num_rows):
        ids = batch.column("ids")[i].values
        starts = batch.column("starts")[i].as_py()
        kind = np.int64 if batch.column("wide")[i].as_py() else np.int32
        blocks = []
        for start, end, sub, codes in zip(starts, [*starts[1:], size], batch.column("dictionaries")[i], batch.column("codes")[i]):
            table = np.frombuffer(sub.as_buffer(), kind).reshape(-1, end - start).astype(np.int64)
            blocks.append((start, end, table, np.frombuffer(codes.as_buffer(), np.uint16)))
        yield ids, blocks


def nearest(blocks, centroids: list[list[int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of every vector of a chunk, and its squared distance."""
    largest = max((int(np.abs(table).max()) for _, _, table, _ in blocks), default=0)
    exact = max(largest, max(abs(x) for c in centroids for x in c)) >= PLAIN or len(centroids[0]) > 64
    kind = object if exact else np.int64
    centres = np.array(centroids, kind)
    total = np.zeros((n, len(centroids)), kind)
    for start, end, table, codes in blocks:
        apart = table.astype(kind)[:, None, :] - centres[None, :, start:end]
        total += (apart * apart).sum(axis=2)[codes]
    best = total.argmin(axis=1)
    return best, total[np.arange(n), best]


def summed(centroids: list[list[int]]):
    """Chunks of a task as ``cluster, dim, n, total``: the counts and the exact sums of its vectors by cluster."""
    k, size = len(centroids), len(centroids[0])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * k
        totals = [[0] * size for _ in range(k)]
        for batch in batches:
            for ids, blocks in chunks_in(batch, size):
                best, _ = nearest(blocks, centroids, len(ids))
                for c, n in enumerate(np.bincount(best, minlength=k).tolist()):
                    counts[c] += n
                for start, end, table, codes in blocks:
                    times = np.bincount(codes.astype(np.int64) * k + best, minlength=len(table) * k).reshape(-1, k)
                    plain = int(np.abs(table).max()) < 2**46
                    part = times.T @ table if plain else times.T.astype(object) @ table.astype(object)
                    for c in range(k):
                        for d in range(start, end):
                            totals[c][d] += int(part[c, d - start])
        rows = [(c, d) for c in range(k) if counts[c] for d in range(size)]
        columns = {
            "cluster": pa.array([c for c, _ in rows], pa.int32()),
            "dim": pa.array([d for _, d in rows], pa.int32()),
            "n": pa.array([counts[c] for c, _ in rows], pa.int64()),
            "total": pa.array([Decimal(totals[c][d]) for c, d in rows], pa.decimal128(38, 0)),
        }
        yield pa.RecordBatch.from_pydict(columns)

    return sums


def assigned(centroids: list[list[int]]):
    """Chunks as ``id, cluster, distance``."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, blocks in chunks_in(batch, len(centroids[0])):
                best, apart = nearest(blocks, centroids, len(ids))
                apart = np.minimum(apart, LONGEST).astype(np.int64)
                yield pa.RecordBatch.from_pydict({"id": ids, "cluster": pa.array(best, pa.int32()), "distance": pa.array(apart)})

    return assign


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def clusters(vectors: DataFrame, id: str, vector: str, k: int, rounds: int, size: int, scale: int, seed: int, chunk: int = CHUNK) -> DataFrame:
    """``id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector (see the module)."""
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col(vector), size, scale)).select(F.col(id).alias("id"), integers(F.col(vector), scale).alias("v"))
    id_type = kept.schema["id"].dataType
    ids = id_type.simpleString()
    shape = f"ids array<{ids}>, starts array<int>, wide boolean, dictionaries array<binary>, codes array<binary>"
    chunks = settle(kept.mapInArrow(encoder(to_arrow_type(id_type), chunk), shape), "chunks")
    order = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    centroids = [list(r.v) for r in kept.orderBy(order, "v").limit(k).collect()]
    result = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return kept.where(F.lit(False)).select(F.col("id").alias(id), *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in result.split(", "))])
    with short_batches(spark, CHUNKS_AT_ONCE):
        for _ in range(rounds):
            parts = chunks.mapInArrow(summed(centroids), "cluster int, dim int, n long, total decimal(38,0)")
            after = [list(c) for c in centroids]
            for r in parts.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
                after[r.cluster][r.dim] = int(r.total) // r.n
            if after == centroids:
                break
            centroids = after
        rows = settle(chunks.mapInArrow(assigned(centroids), f"id {ids}, cluster int, distance long"), "assigned")
    sums = {r.cluster: int(r.total) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    named = [(c, min(sums.get(c, 0), LONGEST), min(sum(sums.values()), LONGEST), digest(x)) for c, x in enumerate(centroids)]
    named = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(named), "cluster").select(F.col("id").alias(id), *[c.split()[0] for c in result.split(", ")])


def oracle(k: int, rounds: int, size: int, scale: int, seed: int) -> str:
    """The same rows in SQL over ``embeddings (vec_id, embedding)``: every round is a pair of common table expressions."""
    apart = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT"
    parts = [
        f"""kept AS MATERIALIZED (
            SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
            WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) - 1 AS cluster, v FROM kept
            QUALIFY row_number() OVER (ORDER BY sha256('{seed}:' || vec_id)) <= {k})""",
    ]
    for r in range(rounds + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
            SELECT vec_id, any_value(v) AS v, min(near) AS near FROM (
                SELECT k.vec_id, k.v, {{'distance': {apart}, 'cluster': c.cluster}} AS near FROM kept k, c{r} c)
            GROUP BY vec_id)"""
        )
        if r < rounds:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
            SELECT cluster, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN (
                SELECT cluster, list((total - ((total % n) + n) % n) // n ORDER BY i) AS v FROM (
                    SELECT near.cluster AS cluster, i, sum(v[i])::BIGINT AS total, count(*) AS n
                    FROM a{r}, (SELECT unnest(range(1, {size + 1})) AS i) GROUP BY 1, 2)
                GROUP BY cluster) m USING (cluster))"""
            )
    return f"""WITH {", ".join(parts)}
        SELECT vec_id, near.cluster::INT AS cluster, near.distance AS distance,
            sum(near.distance) OVER (PARTITION BY near.cluster)::BIGINT AS cluster_inertia,
            sum(near.distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} JOIN c{rounds} c ON c.cluster = near.cluster"""
