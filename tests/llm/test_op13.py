import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import spelling_trie as S
from tallyloom.llm.queries import ORACLE, QUERIES

LOWER = {c: c + 32 for c in range(65, 91)}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[at + 1 :] == b[at + 1 :] if len(a) == len(b) else max(a, b, key=len)[at + 1 :] == min(a, b, key=len)[at:]


def counted(rows, every, shortest, rarest):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(LOWER)):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= shortest and c >= rarest}


def plain(rows, every=199, shortest=6, rarest=5, times=5):
    n = counted(rows, every, shortest, rarest)
    found = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(vs, key=lambda v: (-n[v], v)) if vs and max(n[v] for v in vs) >= times * n[w] else None for w, vs in found.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(found[w]), None if form[w] is None else n[form[w]]) for w in n}


def ran(docs, rows, **more):
    return Counter(tuple(r) for r in S.variants(docs(rows, extra="word"), "doc_id", "text", **more).collect())


def words_of(spark, words):
    return {tuple(r) for r in S.neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}


@pytest.mark.parametrize("letters,lengths,size", [("ab", (6, 10), 150), ("abcdé", (6, 8), 300), ("aÿ", (6, 7), 200), ("abcdefghijklmnopqrstuvwxyz", (6, 7), 200)])
def test_neighbours_against_all_pairs(spark, letters, lengths, size):
    rng = np.random.default_rng(size)
    words = {"".join(rng.choice(list(letters), rng.integers(lengths[0], lengths[1] + 1))) for _ in range(size)}
    for w in sorted(words)[:40]:
        i = int(rng.integers(0, len(w)))
        words |= {w[:i] + w[i + 1 :] + "a", w[:i] + "b" + w[i:], w + w[-1]}
    words = {w for w in words if len(w) >= 6}
    assert words_of(spark, words) == {(a, b) for a in words for b in words if near(a, b)}


def test_runs_of_one_letter_long_words_and_shared_starts(spark):
    words = {"a" * n for n in range(6, 20)} | {"b" + "a" * n for n in range(5, 12)} | {"a" * n + "b" for n in range(5, 12)}
    long = "xyz" * 100
    words |= {long, long[:200] + long[201:], long[:10] + "q" + long[10:], long + "x", "q" + long[1:], long[:-1], long[:150] + "k" + long[151:]}
    words |= {"common" + a + b for a in "abcdefgh" for b in "abcdefgh"}
    assert words_of(spark, words) == {(a, b) for a in words for b in words if near(a, b)}


def test_words_counts_forms_and_roots(docs):
    chain = "letter " * 500 + "lettera " * 100 + "letterab " * 20 + "letterabc " * 4
    rows = [(i, f"Kitten's kittens, KITTEN kitteN—mitten smitten Überall überall {chain}") for i in range(30)]
    rows += [(i, "mittens mittens mittens wörter wörtér " * 3) for i in range(100, 140)]
    rows += [(1, None), (2, ""), (3, "ÀÉÎ×÷ øøøøøøøø"), (None, "kitten " * 50), (4, "kitten"), (4, "kitten")]
    got = ran(docs, rows)
    assert set(got) == plain(rows) and set(got.values()) == {1}
    by = {r[0]: r for r in got}
    assert by["letterabc"][1:3] == ("letterab", "letter") and by["Überall"][0] == "Überall"


def test_misspelled_runs_follow_the_hash(docs):
    rows = [(i, "abcdefgh abcdefg") for i in range(400)]
    assert set(ran(docs, rows, every=3, rarest=2, times=2)) == plain(rows, every=3, rarest=2, times=2)


def test_ties_go_to_the_smaller_word(docs):
    rows = [(1, "wordab " * 50 + "wordac " * 50 + "wordad " * 10)]
    assert {r[0]: r[1] for r in ran(docs, rows, every=10**9)} == {"wordab": None, "wordac": None, "wordad": "wordab"}


def test_joins_beyond_the_broadcast_bound(docs, monkeypatch):
    from tallyloom import session

    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    rows = [(i, "common commons uncommon commonly " * 3 + f"other{'abcdef'[i % 6]} " * 9) for i in range(12)]
    assert set(ran(docs, rows)) == plain(rows)


def test_empty(docs, spark):
    assert ran(docs, []) == Counter() and ran(docs, [(1, "few words")]) == Counter()


def test_query_and_sql(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in QUERIES["op13_spelling_variants"](spark, sf).collect()}
    assert {r[0]: r[3] for r in got} == counted(rows, 199, 6, 5)
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert got == set(base.sql(ORACLE["op13_spelling_variants"]).fetchall()) and len(got) > 100


def test_a_walk_starts_past_the_first_nodes(spark):
    nodes = S.trie(spark.createDataFrame([("letter",), ("lettuce",), ("bettor",)], "word string"))
    assert nodes.agg(F.min(F.length("node"))).first()[0] >= 2


def test_only_edges_that_lead_on_are_listed(spark):
    """The ways on are listed after the edges without any have gone, by compiled code alone."""
    nodes = S.settle(S.trie(spark.createDataFrame([("letter",), ("lettuce",), ("letters",)], "word string")), "trie")
    states = spark.createDataFrame([(0, "letter", 3, "let", 0)], "back int, path string, at int, node string, edits int")
    plan = S.step(states, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
    first, second = plan.index("Generate inline"), plan.rindex("Generate inline")
    assert first < plan.rindex("StartsWith(") < second
