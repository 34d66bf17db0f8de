"""Neighbour selection, blocked neighbours and components against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from tallyloom import session
from tallyloom.operators import selection as S
from tallyloom.operators import similarity as K


def walked(rows, room, seed, turn):
    """The ids that a plain walk in seeded order takes; ``rows``: query -> (id, n)."""
    out = []
    for q in sorted(rows, key=lambda q: (hashlib.md5(f"{seed}:{turn}:{q}".encode()).hexdigest(), q)):
        if rows[q][1] <= room:
            out.append(q)
            room -= rows[q][1]
    return out


@pytest.mark.parametrize("case", range(4))
def test_boundary_round_against_a_plain_walk(spark, monkeypatch, case):
    """Small and large rows mixed, empty rows, a room that nothing fills, parts of one slice or of all."""
    monkeypatch.setattr(S, "PART_DIGITS", [4, 2, 1, 0][case])
    rnd = random.Random(case)
    pick = [lambda: rnd.randint(1, 900), lambda: int(rnd.paretovariate(0.7)), lambda: rnd.choice([0, 1, 400, 401]), lambda: 1000][case]
    rows = {q: (q % 37, pick()) for q in range(400)}
    table = [(1, q, 1, i, 0.5, n) for q, (i, n) in rows.items()]
    df = spark.createDataFrame(table, "round int, query bigint, rank int, id bigint, score double, n bigint")
    for room in (0, 999, 5000):
        got = S._fit_in_order(df, room, 7).collect()
        assert sorted(r.query for r in got) == sorted(walked(rows, room, 7, 1))


def rounds(near, n, budget, seed):
    """``near``: query -> ids by rank. Round, query, id of all rows taken, one round after the other."""
    taken, seen, spent, turn = [], set(), 0, 0
    while True:
        turn += 1
        offer = {q: next((i for i in ids if i not in seen), None) for q, ids in near.items()}
        offer = {q: (i, n[i]) for q, i in offer.items() if i is not None}
        size = sum(x for _, x in offer.values())
        if not offer:
            return taken
        if spent + size > budget:
            return taken + [(turn, q, offer[q][0]) for q in walked(offer, budget - spent, seed, turn)]
        taken += [(turn, q, i) for q, (i, _) in offer.items()]
        spent += size
        seen |= {i for i, _ in offer.values()}


@pytest.mark.parametrize("universe", [12, 60, 400])
def test_rounds_without_repeats_against_a_plain_loop(spark, universe):
    """Lists that share nearly all rows, many, or few; one row is in every list."""
    rnd = random.Random(universe)
    near = {q: [0, *rnd.sample(range(1, universe), 10)] for q in range(30)}
    for ids in near.values():
        rnd.shuffle(ids)
    n = {i: rnd.randint(1, 50) for i in range(universe)}
    df = spark.createDataFrame(
        [(q, r, i, 1.0 / r) for q, ids in near.items() for r, i in enumerate(ids, 1)], "query bigint, rank int, id bigint, score double"
    )
    lengths = spark.createDataFrame(list(n.items()), "id bigint, n bigint")
    for budget in (0, 700, 2500, 10**6):
        got = sorted((r.round, r.query, r.id) for r in S.round_robin_select(df, lengths, budget, 3, dedup=True).collect())
        assert got == sorted(rounds(near, n, budget, 3))


def test_rounds_of_no_neighbours(spark):
    df = spark.createDataFrame([], "query bigint, rank int, id bigint, score double")
    lengths = spark.createDataFrame([(1, 2)], "id bigint, n bigint")
    for dedup in (False, True):
        assert S.round_robin_select(df, lengths, 5, 1, dedup).collect() == []


def test_pairs_of_blocks_against_a_full_product(spark, monkeypatch):
    """Several blocks on both sides, names as texts, more neighbours asked than some blocks hold."""
    rng = np.random.default_rng(4)
    docs, asked = rng.integers(-2, 3, (150, 4)).astype(float), rng.integers(-2, 3, (40, 4)).astype(float)
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(docs)], "id bigint, vec array<double>").repartition(6)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(asked)], "query string, vec array<double>")
    scores = asked @ docs.T
    want = {
        (f"q{i}", rank, int(j)) for i in range(40) for rank, j in enumerate(sorted(range(150), key=lambda j: (-scores[i, j], j))[:25], 1)
    }
    monkeypatch.setattr(K, "BLOCK_BYTES", 4 * 8 * 16)
    got = K.knn_topk(q, d, 25)
    assert {(r.query, r["rank"], r.id) for r in got.collect()} == want
    assert K.knn_topk(q, d.limit(0), 25).collect() == []


def test_components_around_a_hub(spark, monkeypatch):
    """A node with a third of all keys, with labels beyond the broadcast bound."""
    monkeypatch.setattr(session, "BROADCAST_ROWS", 1)
    edges = [(0, f"h{i}") for i in range(300)] + [(i + 1, f"h{i}") for i in range(300)] + [(i, f"own{i}") for i in range(1000, 1300)]
    got = {r.node: r.component for r in S.group_components(spark.createDataFrame(edges, "node bigint, key string")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[i] == i for i in range(1000, 1300))
