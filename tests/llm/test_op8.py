import math

import numpy as np
import pytest

from tallyloom.llm import embedding_dedup
from tallyloom.llm.queries import QUERIES


def plain(rows, least=0.9):
    """Links and components of all pairs: ``(id, links, component, kept)``."""
    good = [i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    parent, n = {i: i for i in good}, dict.fromkeys(good, 0)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    by_length = {}
    for i in good:
        by_length.setdefault(len(rows[i][1]), []).append(i)
    for many in by_length.values():
        x = embedding_dedup.unit(np.array([rows[i][1] for i in many], float))
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            n[many[a]] += 1
            n[many[b]] += 1
            parent[root(many[a])] = root(many[b])
    least_id = {}
    for i in good:
        least_id[root(i)] = min(least_id.get(root(i), rows[i][0]), rows[i][0])
    return [(k, n.get(i, 0), least_id[root(i)] if i in parent else k) for i, (k, _) in enumerate(rows)]


def key(row):
    return tuple((x is None, x or 0) for x in row)


def run(spark, rows):
    table = spark.createDataFrame([(k, v, 1) for k, v in rows], "vec_id long, embedding array<float>, n int")
    got = embedding_dedup.near_duplicates(spark, table).collect()
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)
    return [(r.vec_id, r.n_links, r.component_id) for r in got]


def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [(r.vec_id, r.n_links, r.component_id) for r in QUERIES["op8_embedding_near_dedup"](spark, sf).collect()]
    assert sorted(got) == sorted(plain(rows))


def close(rng, centre, n, cosine):
    """Vectors at about the given cosine from a centre."""
    noise = rng.standard_normal((n, len(centre)))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return (centre * cosine + noise * math.sqrt(1 - cosine**2)).astype(np.float32)


def test_groups_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    centre = embedding_dedup.unit(rng.standard_normal((3, 64)))
    x = np.concatenate([rng.standard_normal((80, 64)), close(rng, centre[0], 60, 0.998), close(rng, centre[1], 40, 0.999)]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, rows[5][1]) for i in range(25)] + [(rows[90][0], rows[90][1]), (2000, [2 * y for y in rows[90][1]])]
    rows += [(3000, None), (3001, [0.0] * 64), (3002, [None] + [1.0] * 63), (3003, [float("nan")] * 64), (3004, [float("inf")] * 64), (3005, []), (None, rows[5][1]), (3006, [1.0, 0.0]), (3007, [2.0, 0.0]), (3008, [0.0, 3.0])]
    assert sorted(run(spark, rows), key=key) == sorted(plain(rows), key=key)


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 32)
    rng = np.random.default_rng(4)
    centre = embedding_dedup.unit(rng.standard_normal((1, 64)))[0]
    x = np.concatenate([close(rng, centre, 150, 0.9995), rng.standard_normal((50, 64)).astype(np.float32)])
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x, strict=True)]
    assert sorted(run(spark, rows)) == sorted(plain(rows))


@pytest.mark.parametrize("dims", [8, 16, 24, 32, 64])
@pytest.mark.parametrize("cosine", [0.92, 0.95, 0.99])
def test_recall_of_pairs(spark, monkeypatch, cosine, dims):
    """Share of planted pairs at a given cosine and length that the index finds, against brute force."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 256)
    rng = np.random.default_rng(6)
    a = embedding_dedup.unit(rng.standard_normal((400, dims)))
    b = np.concatenate([close(rng, v, 1, cosine) for v in a])
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]).astype(np.float32))]
    want, got = dict(x[:2] for x in plain(rows)), dict(x[:2] for x in run(spark, rows))
    assert all(got[i] <= want[i] for i in want)
    assert sum(got.values()) >= 0.9 * sum(want.values())


def test_many_lengths_and_lone_pairs(spark):
    """Every length has its links, also one of two vectors; no length is left out."""
    rng = np.random.default_rng(8)
    rows = []
    for dims in range(1, 1301):
        v = embedding_dedup.unit(rng.standard_normal((1, dims)))[0]
        rows.append((2 * dims, v.tolist()))
        rows.append((2 * dims + 1, (v * 1.5 + (0.01 / dims)).tolist()))
    got = run(spark, rows)
    assert sorted(got) == sorted(plain(rows))
    assert sum(n for _, n, _ in got) == 2600


def test_empty(spark):
    assert run(spark, []) == []
