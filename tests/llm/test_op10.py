import base64
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tallyloom.llm import token_counts
from tallyloom.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})




def test_query(spark, sf, encoding):
    """Counts before and after the edits, against encoding the whole texts."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text", token_counts.sample_edits(F.col("text")).alias("e")).collect()
    got = {r.doc_id: r for r in QUERIES["op10_token_counts"](spark, sf).collect()}
    assert len(got) == len(rows)
    for r in rows:
        text = r.text or ""
        g = got[r.doc_id]
        assert (g.n_chars, g.n_tokens) == (len(text), len(encoding.encode_ordinary(text)))
        for e in r.e:
            start = min(e.start, len(text))
            text = text[:start] + e.text + text[max(start, min(e.end, len(text))) :]
        assert (g.edited_n_chars, g.edited_n_tokens, g.n_edits) == (len(text), len(encoding.encode_ordinary(text)), 3)
    long = [g for g in got.values() if g.n_chars > 20_000]
    assert all(g.encoded_chars < g.n_chars / 2 for g in long)


def test_random_edits(encoding):
    rng = random.Random(2)
    bits = ["word ", "a", "  ", "\n\n", "'ll", "12", "!?", "é", "日本", " The", "-" * 9, "\t", "I'"]

    def piece(n):
        return "".join(rng.choice(bits) for _ in range(rng.randint(0, n)))

    def count(leaves):
        return [len(encoding.encode_ordinary(x)) for x in leaves]

    for _ in range(60):
        text = piece(800)
        tree = token_counts.SegmentTree(text, count)
        for _ in range(12):
            a = rng.randint(-2, len(text) + 2)
            b = a + rng.choice([0, 1, 5, 300, 2000])
            new = piece(rng.choice([0, 1, 4, 400]))
            tree.edit(a, b, new)
            s = min(max(a, 0), len(text))
            text = text[:s] + new + text[min(max(b, s), len(text)) :]
            assert tree.text == text and tree.n_chars == len(text)
            assert tree.n_tokens == len(encoding.encode_ordinary(text))


def test_an_edit_encodes_little(encoding):
    tree = token_counts.SegmentTree("some words go here " * 20_000, lambda leaves: [len(encoding.encode_ordinary(x)) for x in leaves])
    tree.encoded = 0
    tree.edit(190_000, 190_004, "other")
    assert 0 < tree.encoded < 2000


def test_odd_rows(spark, docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "abc"), (5, "word " * 30_000)]
    edits = F.array(F.struct(F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit("xy z").alias("text")))
    got = token_counts.counted(spark, docs(rows, "n_tokens"), "doc_id", edits, PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == 5
    assert sorted(r.edited_n_chars for r in got) == [4, 4, 4, 6, 150_003]
    none = token_counts.counted(spark, docs(rows), "doc_id", F.lit(None).cast("array<struct<start:int,end:int,text:string>>"), PATH, public_tokenizers.PATTERN)
    assert all(r.n_edits == 0 and r.n_tokens == r.edited_n_tokens for r in none.collect())
    assert token_counts.counted(spark, docs([]), "doc_id", edits, PATH, public_tokenizers.PATTERN).collect() == []
