import base64
import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_op4 import brute
from test_op5 import filled

import corpus_pipeline as P
from tallyloom.llm import mixing, pii, toxicity
from tallyloom.llm.common import fold
from tallyloom.session import settle


@pytest.fixture(scope="module")
def stages(spark):
    """The documents and the result of every stage on the small tables."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in P.STAGES:
        out.append(settle(stage(spark, out[-1], sf), name))
    return out


def test_stages_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "minhash_near_dedup", "pii", "source_mix", "byte_bpe"]
    for df in stages[1:-1]:
        assert dict(df.dtypes) == dict(stages[0].dtypes)


def test_toxic_documents_go(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = toxicity.fitted(stages[0].where(fold(F.col("doc_id")) != 0), labels)
    scores = toxicity.scored(spark, stages[0], net, ["doc_id"]).collect()
    assert {r.doc_id for r in stages[1].collect()} == {r.doc_id for r in scores if r.score < 0.5}
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert np.mean([i in kept for i, t in marked.items() if t == 0]) > 0.97


def test_one_of_each_group_stays(stages):
    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    want = {i for i, _, c in brute(rows, 5, 80) if i == c}
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(want)


def test_personal_data_is_replaced(stages):
    before = {r.doc_id: r for r in stages[2].collect()}
    after = {r.doc_id: r for r in stages[3].collect()}
    assert before.keys() == after.keys()
    for i, r in after.items():
        assert r.text == pii.redact(before[i].text) and r.n_chars == len(r.text) and r.source == before[i].source
    assert not any(pii.base_spans(r.text) for r in after.values())


def test_sources_meet_their_targets(stages):
    def words(rows):
        out = {}
        for r in rows:
            out[r.source] = out.get(r.source, 0) + len(r.text.encode().split())
        return out

    before, after = words(stages[3].collect()), words(stages[4].collect())
    names = sorted(before, key=lambda s: s.encode())
    for name, target in zip(names, filled([before[s] for s in names]), strict=True):
        assert abs(after[name] - target) <= 2 * mixing.BLOCK
    texts = {r.doc_id: r.text.split() for r in stages[3].collect()}
    for r in stages[4].collect():
        assert set(r.text.split()) <= set(texts[r.doc_id]) and len(r.text.split()) <= len(texts[r.doc_id])


def test_texts_are_encoded(stages):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(P.RANKS), "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, encoding.encode_ordinary(r.text), hashlib.sha256(r.text.encode()).hexdigest()) for r in stages[4].collect())
    got = sorted((r.doc_id, r.ids, r.decoded_sha256) for r in stages[5].collect())
    assert got == want
    assert all(r.n_tokens == len(r.ids) for r in stages[5].collect())


def test_run_is_the_stages_in_turn(spark, stages):
    rows = P.run(spark, "/root/testdata/sf0.01").select("doc_id", "ids_sha256").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[5].select("doc_id", "ids_sha256").collect()))


def test_odd_documents(spark, stages):
    """Null, empty and repeated rows, missing ids and sources, an extra column whose name clashes with the operators' own."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, group string"
    long = "some words that go on " * 4000
    rows = [(1, None, "en", "a", 0, "g"), (2, "", None, None, 0, None), (2, "", None, None, 0, None), (None, "call +1 (555) 123-4567 now", "en", "a", 9, "x"),
            (5, long, "en", None, 9, "x"), (6, long + "more", "en", "a", 9, "x")]
    docs = spark.createDataFrame(rows, schema)
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert name == "byte_bpe" or docs.columns == [f.split()[0] for f in schema.split(", ")]
    assert {r.doc_id for r in docs.collect()} <= {None, 5}
    assert docs.count() > 0


def test_empty_documents(spark, stages):
    docs = stages[0].limit(0)
    for name, stage in P.STAGES:
        docs = settle(stage(spark, docs, "/root/testdata/sf0.01"), name)
        assert docs.count() == 0
