import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import mixing
from tallyloom.llm.queries import QUERIES


def filled(sizes, share=1.5, cap=2.0, weights=(3, 1, 2)):
    """Targets by giving, round after round, the excess to those below their limit."""
    weight = np.array([weights[i % len(weights)] for i in range(len(sizes))], float)
    sizes = np.array(sizes, float)
    target = np.zeros(len(sizes))
    closed = np.zeros(len(sizes), bool)
    while not closed.all():
        rest = share * sizes.sum() - target[closed].sum()
        given = rest * weight / weight[~closed].sum()
        over = ~closed & (given > cap * sizes)
        target[~closed] = given[~closed]
        if not over.any():
            break
        target[over] = cap * sizes[over]
        closed |= over
    return target


def check(rows, near):
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = [sum(r["size"] for r in by[s]) for s in names]
    for s, size, want in zip(names, sizes, filled(sizes), strict=True):
        assert {r.source_size for r in by[s]} == {size}
        assert all(r.target == pytest.approx(want) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - want) <= near


def test_query(spark, sf):
    rows = QUERIES["op5_source_mix"](spark, sf).collect()
    check(rows, 2 * mixing.BLOCK)
    again = QUERIES["op5_source_mix"](spark, sf).collect()
    assert sorted((r.doc_id, r.taken) for r in rows) == sorted((r.doc_id, r.taken) for r in again)
    words = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")).alias("n"))
    assert {r.doc_id: r["size"] for r in rows} == {r.doc_id: r.n for r in words.collect()}


def test_odd_rows(spark, docs):
    given = [(1, None, "b"), (2, "", "b"), (3, "x " * 900, "a"), (4, "y " * 10, None), (5, "z " * 3000, "b"), (5, "z " * 3000, "b"), (None, "w " * 40, "é"), (None, None, None)]
    rows = mixing.taken_words(spark, docs(given, "target"), block=16, shard_slots=8).collect()
    assert len(rows) == len(given)
    check(rows, 32)


def test_empty(spark, docs):
    assert mixing.taken_words(spark, docs([])).collect() == []
    nothing = mixing.taken_words(spark, docs([(1, None), (2, "")])).collect()
    assert [(r["size"], r.taken) for r in nothing] == [(0, 0), (0, 0)]


def test_permutations():
    for n in (1, 2, 3, 7, 100, 1025):
        index = np.arange(n)
        for key in (0, 5, 2**40):
            got = mixing.permuted(index, np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(got.tolist()) == list(range(n))


def test_mixed_texts(spark, docs):
    """Every document's words in the mix are those the plan takes, in their order."""
    given = [(i, " ".join(f"w{i}_{k}" for k in range(n)), s) for i, (n, s) in enumerate([(300, "a"), (5, "a"), (70, "b"), (0, "b"), (41, None), (41, None)])]
    table = docs(given, "rank").withColumn("n_chars", F.length("text"))
    plan = {r.doc_id: r.taken for r in mixing.taken_words(spark, table, block=8, shard_slots=4).collect()}
    mixed = mixing.mixed_documents(spark, table, block=8, shard_slots=4)
    assert mixed.columns == table.columns
    got = mixed.collect()
    for i, text, _ in given:
        mine = [r.text.split() for r in got if r.doc_id == i]
        assert sum(map(len, mine)) == plan[i] and len(mine) <= 2
        for words in mine:
            places = [int(w.split("_")[1]) for w in words]
            assert places == sorted(set(places)) and set(words) <= set(text.split())
    assert all(r.n_chars == len(r.text) for r in got)


def test_clashing_names(spark, docs):
    """Further columns keep their names and values, whatever the columns of the steps in between are called."""
    given = [(i, f"w{i} " * (20 + 30 * i), "ab"[i % 2]) for i in range(6)]
    table = docs(given).withColumn("n_chars", F.length("text"))
    names = ["runs", "rank", "start", "pass", "block", "blocks", "size", "lo", "hi", "shard", "first", "times", "target", "source_size", "__t", "__copy", "__s", "__n", "__h"]
    further = table.select("*", *[F.concat(F.lit(f"{n} "), "doc_id").alias(n) for n in names if n not in table.columns])
    plain = mixing.mixed_documents(spark, table, block=8, shard_slots=4)
    mixed = mixing.mixed_documents(spark, further, block=8, shard_slots=4)
    assert mixed.columns == further.columns
    rows = mixed.collect()
    assert all(r[n] == f"{n} {r.doc_id}" for r in rows for n in further.columns if n not in table.columns)
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    taken = {r.doc_id: r.taken for r in mixing.taken_words(spark, table, block=8, shard_slots=4).collect()}
    assert taken == {r.doc_id: r.taken for r in mixing.taken_words(spark, further, block=8, shard_slots=4).collect()}
