import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm import toxicity
from tallyloom.llm.queries import QUERIES


@pytest.fixture(scope="module")
def net(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return toxicity.fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in got.items())
    held = [(got[k].predicted, v) for k, v in labels.items() if got[k].held_out]
    assert np.mean([p == v for p, v in held]) >= 0.9


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    texts = ["bad word here " * 3, "fine text there " * 3, "bad again", "good and well"] * 3
    net = toxicity.train(texts, [1, 0, 1, 0] * 3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x = rng.standard_normal((6, toxicity.WIDTH))
    codes, mask = rng.integers(0, 6, (4, 5)), (np.arange(5) < np.array([[5], [3], [1], [5]])).astype(float)
    target = np.array([1.0, 0, 1, 0])
    _, grads, dx = net.backward(x, codes, mask, target)
    for name in ("Wf", "Ub", "Vf", "cb", "Wa", "va", "wo", "co"):
        weight = net.p[name]
        for at in list(np.ndindex(weight.shape))[:: max(1, weight.size // 3)]:
            old = weight[at]
            values = []
            for step in (1e-3, -1e-3):
                weight[at] = old + step
                values.append(net.backward(x, codes, mask, target)[0])
            weight[at] = old
            assert grads[name][at] == pytest.approx((values[0] - values[1]) / 2e-3, rel=3e-2, abs=2e-4)
    old, values = x[2, 1], []
    for step in (1e-3, -1e-3):
        x[2, 1] = old + step
        values.append(net.backward(x, codes, mask, target)[0])
    assert dx[2, 1] == pytest.approx((values[0] - values[1]) / 2e-3, rel=3e-2, abs=2e-4)


def test_windows_cover_every_word():
    for n in range(0, 300):
        seen = {w for s in toxicity.windows_of(n) for w in range(s, s + toxicity.WINDOW)}
        assert seen >= set(range(n))


def test_a_text_scores_as_its_highest_window(net):
    words = [f"word{i}" for i in range(500)]
    whole = net.score(pa.array([" ".join(words)]))[0]
    parts = [" ".join(words[s : s + toxicity.WINDOW]) for s in toxicity.windows_of(len(words))]
    assert whole == pytest.approx(net.score(pa.array(parts)).max(), abs=1e-4)


def test_late_words_count(net):
    clean = "the and of to in that is was for on " * 2000
    low, high = net.probability(pa.array([clean, clean + " idiot moron scum"]))
    assert high > low


def test_odd_rows(spark, docs, net):
    rows = [(1, None), (2, ""), (2, ""), (None, "é " * 3), (5, "x" * 100_000)]
    got = toxicity.scored(spark, docs(rows), net, ["doc_id", "source"], "p").collect()
    assert len(got) == 5 and all(0 <= r.p <= 1 for r in got)
    scores = {r.doc_id: r.p for r in got}
    assert scores[1] == scores[2]
    kept = toxicity.scored(spark, docs(rows), net, ["text", "doc_id", "score"], "__score")
    assert kept.columns == ["text", "doc_id", "score", "__score"] and kept.where("text IS NULL").count() == 1
    assert toxicity.scored(spark, docs([]), net, ["doc_id"]).collect() == []


def test_without_both_classes(spark, docs):
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    table = docs([(1, "a"), (2, "b")])
    assert toxicity.fitted(table, labels) is None
    assert [r.score for r in toxicity.scored(spark, table, None, ["doc_id"]).collect()] == [0.0, 0.0]


def test_labels_of_other_documents_take_no_place(spark, docs):
    rows = [(i, f"text {i} {'scum' if i % 2 else 'kind'}") for i in range(200)] + [(7, "again")]
    given = [(i, i % 2) for i in range(200)] + [(i, i % 2) for i in range(1000, 9000)]
    labels = spark.createDataFrame(given, "doc_id long, toxic int")
    texts, classes = toxicity.sample(docs(rows), labels, most=120)
    assert len(texts) == 201 and sum(classes) == 101 and "again" in texts
    texts, classes = toxicity.sample(docs(rows), labels, most=30)
    assert len(texts) == 60 and sum(classes) == 30
    texts, classes = toxicity.sample(docs([*rows, (9999, "x" * 5000)]), labels.unionAll(spark.createDataFrame([(9999, 1)], labels.schema)), most_bytes=1000)
    assert max(map(len, texts)) < 100 and sum(map(len, texts)) <= 2000 and len(set(classes)) == 2


def test_training_holds_its_ngrams_once(monkeypatch):
    """The driver is small: the n-grams of the training words are never held beside copies of them all."""
    monkeypatch.setattr(toxicity, "ROUNDS", 1)
    monkeypatch.setattr(toxicity, "STEPS", toxicity.FOLDS)
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    texts = [" ".join("".join(w) for w in letters[rng.integers(0, 26, (300, 18))]) for _ in range(200)]
    words = pa.array(sorted({w for t in texts for w in t.split()}))
    ends = toxicity.grams_of(words)[1]
    tracemalloc.start()
    try:
        assert toxicity.train(texts, [0, 1] * 100) is not None
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 3 * 8 * ends[-1]
    assert toxicity.gram_ends(words).tolist() == ends.tolist()
