"""Embeddings and exact nearest neighbours."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.once import let, pinned
from ..functions.seeded import hex_int
from ..functions.text import words
from ..session import settle
from .ordering import per_group_limit

# Vectors of a block, in bytes of float64, and scores that a task makes at a time.
BLOCK_BYTES = 32 * 2**20
TILE_CELLS = 4_000_000


def embed(texts: DataFrame, key: str, text: str = "text", dim: int = 64, fn=None) -> DataFrame:
    """``key, vec`` with unit vectors; ``fn`` is a pandas UDF text -> array<float>.

    The default counts hashed tokens inside the row. A text without words, or null, has the zero vector.
    """
    if fn is not None:
        return texts.select(key, unit(fn(F.col(text))).alias("vec"))

    def slot(t):
        return F.pmod(hex_int(F.substring(F.md5(t), 1, 8)), F.lit(dim)).cast("int")

    def counts(ordered):
        # Every slot is put in once, so it starts somewhere in the ordered slots; its run is one longer than its count.
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ordered) - 1), lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1))
        )
        return let(starts, lambda s: F.transform(s, lambda a, k: (F.coalesce(F.get(s, k + 1), F.size(ordered)) - a - 1).cast("double")))

    once = F.sequence(F.lit(0), F.lit(dim - 1))
    held = F.transform(words(F.coalesce(F.col(text), F.lit(""))), slot)
    rows = pinned(texts, {"__slots": F.sort_array(F.concat(held, once))}, [key])
    return pinned(rows, {"vec": unit(let(F.col("__slots"), counts))}, [key])


def unit(vec):
    """Vector over its length; a zero vector stays zero."""

    def scaled(v):
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return let(norm, lambda s: F.transform(v, lambda x: F.when(s > 0, x / s).otherwise(F.lit(0.0))))

    return let(vec.cast("array<double>"), scaled)


def label_centroids(vectors: DataFrame, vec: str = "embedding", label: str = "label") -> DataFrame:
    """Mean vector per label as ``query, vec``; one row per label and dimension crosses the shuffle per task."""
    parts = vectors.select(label, F.posexplode(vec).alias("i", "x"))
    means = parts.groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = means.groupBy(label).agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    return rows.select(F.col(label).alias("query"), unit(F.transform("p", lambda q: q["x"])).alias("vec"))


def knn_topk(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact ``k`` nearest documents of every query by the dot product of unit vectors: ``query, rank, id, score``.

    Query vectors of at most BLOCK_BYTES are sent to the tasks and the documents stay where they are. More of them are dealt
    to blocks of that size, and the documents to blocks of their own; one shuffle brings every pair of blocks together, so
    the documents are read once however many queries there are, and no block passes the driver. Either way scores are made in
    tiles of bounded size and a task keeps ``k`` per query, so only those reach the shuffle behind. Ties go to the smaller id.
    """
    q = settle(queries.select("query", "vec"), "queries")
    n_blocks = _blocks(q, "vec")
    rows = docs.select("id", "vec")
    near = _near_sent(q, rows, k) if n_blocks <= 1 else _near_blocks(q, rows, k, n_blocks)
    ranked = per_group_limit(near, ["query"], [F.desc("score"), F.col("id")], k)
    return ranked.select("query", F.col("rank").cast("int").alias("rank"), "id", "score")


def _blocks(rows: DataFrame, vec: str) -> int:
    size = rows.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("d")).first()
    return -(-(size.n * (size.d or 1) * 8) // BLOCK_BYTES)


def _near_type(q: DataFrame, docs: DataFrame) -> str:
    return f"query {q.schema['query'].dataType.simpleString()}, id {docs.schema['id'].dataType.simpleString()}, score double"


def _near_sent(q: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Per task, the nearest documents of queries that fit one block; a table without queries gives no rows."""
    block = q.toArrow()
    if not block.num_rows:
        return docs.sparkSession.createDataFrame([], _near_type(q, docs))
    sent = docs.sparkSession.sparkContext.broadcast((block["query"].to_numpy(), np.vstack(block["vec"].to_numpy())))

    def nearest(batches):
        names, mat = sent.value
        held = None
        for batch in batches:
            held = _nearer(held, names, mat, batch, k)
        if held is not None:
            yield _named(held, names)

    return docs.mapInPandas(nearest, _near_type(q, docs))


def _near_blocks(q: DataFrame, docs: DataFrame, k: int, n_blocks: int) -> DataFrame:
    """Per pair of a query block and a document block, the nearest documents of its queries."""
    rows = settle(docs, "vectors")
    n_parts = max(1, _blocks(rows, "vec"))
    keys = ["__block", "__part"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = q.withColumn("__block", dealt("query", n_blocks)).withColumn("__part", every(n_parts))
    right = rows.withColumn("__part", dealt("id", n_parts)).withColumn("__block", every(n_blocks))

    def nearest(asked, held_docs):
        if not len(asked) or not len(held_docs):
            return _named(None, None)
        names = asked["query"].to_numpy()
        return _named(_nearer(None, names, np.vstack(asked["vec"].to_numpy()), held_docs, k), names)

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(nearest, _near_type(q, docs))


def _nearer(held, names, mat, docs, k: int):
    """``q, id, score``: the ``k`` nearest per query position among those held and the documents given."""
    import pandas as pd

    tile = max(1, TILE_CELLS // len(names))
    for start in range(0, len(docs), tile):
        part = docs.iloc[start : start + tile]
        # Rounded, so equal vectors tie whatever the order of the sums inside the product.
        scores = np.round(mat @ np.vstack(part["vec"].to_numpy()).T, 12)
        ids = part["id"].to_numpy()
        top = min(k, len(ids))
        # Everything at least as near as the k-th is kept, so ties are settled by id later.
        bound = -np.partition(-scores, top - 1, axis=1)[:, top - 1 : top]
        qi, di = np.nonzero(scores >= bound)
        now = pd.DataFrame({"q": qi, "id": ids[di], "score": scores[qi, di]})
        held = now if held is None else pd.concat([held, now], ignore_index=True)
        held = held.sort_values(["q", "score", "id"], ascending=[True, False, True]).groupby("q").head(k)
    return held


def _named(held, names):
    import pandas as pd

    if held is None:
        return pd.DataFrame({"query": [], "id": [], "score": []}, dtype=object)
    return pd.DataFrame({"query": names[held["q"].to_numpy()], "id": held["id"].to_numpy(), "score": held["score"].to_numpy()})


def knn_join(queries: DataFrame, docs: DataFrame, k: int, payload: DataFrame) -> DataFrame:
    """``knn_topk`` with the documents' own columns attached."""
    return knn_topk(queries, docs, k).join(payload, "id")
