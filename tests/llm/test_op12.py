import hashlib
import math
from collections import Counter

import duckdb
import numpy as np

from tallyloom.llm import centroid_clusters as C
from tallyloom.llm.queries import ORACLE, QUERIES


def plain(rows, k, rounds, size, scale, seed):
    """The contract in Python integers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in first[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((apart(v, c), j) for j, c in enumerate(centres))[::-1]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[0], []).append(v)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    rows = [(i, *near(v)) for i, v in kept]
    inertia = Counter()
    for _, c, d in rows:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    top = 2**63 - 1
    return Counter((i, c, min(d, top), min(inertia[c], top), min(sum(inertia.values()), top), sha[c]) for i, c, d in rows)


def ran(spark, rows, k=3, rounds=4, size=4, scale=16, seed=3, kind="double", **more):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, id int")
    return Counter(tuple(r) for r in C.clusters(table, "vec_id", "embedding", k, rounds, size, scale, seed, **more).collect())


def test_blocks_are_lossless():
    rng = np.random.default_rng(1)
    for rows in (rng.integers(-500, 500, (300, 16)), rng.integers(0, 2, (300, 16)), np.tile(rng.integers(0, 99, 16), (300, 1)), rng.integers(0, 9, (1, 16))):
        blocks = C.blocks_of(rows)
        assert np.array_equal(np.hstack([sub[codes] for _, sub, codes in blocks]), rows)
        assert all(len(np.unique(sub, axis=0)) == len(sub) for _, sub, _ in blocks)
    # Copies are one block over all dimensions, coarse components wide blocks.
    assert len(C.blocks_of(np.tile(rng.integers(0, 99, 16), (300, 1)))) == 1
    assert 1 < len(C.blocks_of(rng.integers(0, 2, (300, 16)))) <= 4


def test_against_plain_integers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)]
    rows += [(500 + i, rows[0][1]) for i in range(60)] + [rows[1], rows[1], (None, [0.5] * 4)]
    rows += [(900, None), (901, []), (902, [1.0] * 3), (903, [1.0] * 5), (904, [1.0, None, 1.0, 1.0]), (905, [math.nan] * 4), (906, [math.inf, 0.0, 0.0, 0.0])]
    for k, rounds in ((3, 4), (8, 10), (1, 2), (500, 1)):
        assert ran(spark, rows, k, rounds) == plain(rows, k, rounds, 4, 16, 3)


def test_more_chunks_than_one(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-3, 3, 4).astype(float).tolist()) for i in range(300)]
    assert ran(spark, rows, 4, 5, chunk=7) == plain(rows, 4, 5, 4, 16, 3)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(i * 10**7), 1e9 - i, -1e8 * i, 0.0]) for i in range(30)] + [(100, [2.0**45, 0.0, 0.0, 0.0]), (101, [0.0, -(2.0**45), 1.0, 1.0])]
    assert ran(spark, rows) == plain(rows, 3, 4, 4, 16, 3)
    # A component beyond 63 bits gives no row.
    assert ran(spark, [*rows, (200, [1e300, 0.0, 0.0, 0.0])]) == plain(rows, 3, 4, 4, 16, 3)


def test_ties_go_to_the_smaller_centroid(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(12)]
    got = ran(spark, rows, 6, 3)
    assert got == plain(rows, 6, 3, 4, 16, 3) and len({r[1] for r in got}) == 2


def test_empty(spark):
    assert ran(spark, []) == Counter() and ran(spark, [(1, None)]) == Counter()


def test_query_and_sql(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = Counter(tuple(r) for r in QUERIES["op12_centroid_clusters"](spark, sf).collect())
    assert got == plain(rows, 8, 10, 64, 1024, 3)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS FROM '{sf}/embeddings.parquet'")
    assert got == Counter(base.sql(ORACLE["op12_centroid_clusters"]).fetchall())
