import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import near_dedup
from tallyloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = (text or "").translate(LOWER).encode().split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def brute(rows, size, percent):
    """Components by comparing all pairs that share a shingle: ``row number -> smallest id``."""
    sets = [shingles(t, size) for _, t in rows]
    holders = {}
    for i, s in enumerate(sets):
        for g in s:
            holders.setdefault(g, []).append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    done = set()
    for many in holders.values():
        for a, i in enumerate(many):
            for j in many[:a]:
                if (j, i) not in done:
                    done.add((j, i))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                        parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [(rows[i][0], len(sets[i]), least.get(root(i))) for i in range(len(rows))]


def key(row):
    return tuple((x is None, x or 0) for x in row)


@pytest.mark.parametrize("percent", [85])
def test_query(spark, sf, percent):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_minhash_near_dedup"](spark, sf).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, percent))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, most)):
            words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_large_group_of_near_copies(spark, docs):
    """Copies of one text with up to ten changes: links run through the copies with few, in chains, across blocks."""
    rng = random.Random(3)
    texts = family(rng, [f"w{k}" for k in range(150)], 220, 10) + family(rng, [f"v{k}" for k in range(60)], 40, 4)
    texts += [texts[0]] * 30 + ["x y"] * 3 + ["x  Y\n", "x", "x", "", None, " "]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(None, texts[0]), (7, texts[7])]
    got = near_dedup.near_duplicates(docs(rows, "cls"), "doc_id", 3, 85).collect()
    assert sorted(((r.id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(brute(rows, 3, 85), key=key)


def test_blocks_of_a_large_bucket(spark, docs, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", 1)
    rng = random.Random(5)
    rows = list(enumerate(family(rng, [f"w{k}" for k in range(100)], 90, 9)))
    got = near_dedup.near_duplicates(docs(rows), "doc_id", 3, 85).collect()
    assert sorted((r.id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 3, 85))


def test_empty_table(spark, docs):
    assert near_dedup.near_duplicates(docs([]), "doc_id", 3, 85).collect() == []


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    for shared in (0, 200, 380):
        b = np.concatenate([a[:shared], rng.integers(0, 2**63, 400 - shared).astype(np.uint64)])
        true = shared / (800 - shared)
        assert abs((near_dedup.signature(a, 2048) == near_dedup.signature(b, 2048)).mean() - true) < 0.06


def test_one_of_each(spark, docs):
    base = " ".join(f"w{k}" for k in range(100))
    rows = [(3, base), (2, base + " more"), (2, base + " more"), (9, ""), (9, ""), (8, None), (4, "other words are here now"), (5, "other words are here now")]
    table = docs(rows, "group")
    got = near_dedup.one_of_each(table, "doc_id", 5, 80)
    assert got.columns == table.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(2, base + " more"), (4, "other words are here now"), (8, ""), (9, ""), (9, "")]
    assert got.where(F.col("group") != 1).count() == 0
