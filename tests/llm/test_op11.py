import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import quality_rules as Q
from tallyloom.llm.queries import QUERIES


def plain(text):
    """The counts, by the contract's words."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    inside = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(inside)


def failed(n_words, n_repeat_words):
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words


CASES = [
    None,
    "",
    " \n\t\r\n",
    "one",
    "a b c d e f g h",
    "a b c d e f g h " * 2,
    "a b c d e f g h i " * 3 + "z",
    "x " * 17,
    "same\nsame\n \n \nsame \nother",
    "é€𝄞 #*$ %&|<> \x0b\x0c tail",
    " ".join(f"w{i}" for i in range(3000)) * 2,
    "long" * 50_000,
    "k l m n o p q r\n" * 4,
]


def test_counts_by_plain_words():
    found = Q.statistics(pa.array(CASES))
    for i, text in enumerate(CASES):
        assert tuple(int(found[c][i]) for c in Q.COUNTS) == plain(text)
    assert all(np.isfinite(found[f]).all() for f in Q.FEATURES)


def test_counts_of_random_texts_and_slices():
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), rng.integers(0, 60))) + "\n" * int(rng.integers(0, 3)) for _ in range(200)]
    found = Q.statistics(pa.array(["drop", *texts]).slice(1))
    assert [tuple(int(found[c][i]) for c in Q.COUNTS) for i in range(len(texts))] == [plain(t) for t in texts]


def test_forest_walks_like_one_row_at_a_time():
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(600, 4))
    good = ((rows[:, 0] + rows[:, 1] ** 2 + 0.3 * rng.normal(size=600)) > 0.5).astype(float)
    forest = Q.boosted(rows, good, [])

    def walk(row):
        total = forest.base
        for at in forest.roots:
            while forest.left[at] != at:
                at = (forest.left if row[forest.feature[at]] <= forest.threshold[at] else forest.right)[at]
            total += forest.value[at]
        return total

    assert np.allclose(forest.raw(rows), [walk(r) for r in rows])
    assert ((forest.score(rows) >= 0.5) == good).mean() > 0.95


def test_falling_features_never_raise_the_score():
    rng = np.random.default_rng(7)
    rows = rng.uniform(size=(800, 3))
    # The labels rise with the constrained feature over half its range, so free trees would follow.
    good = ((np.sin(6 * rows[:, 0]) + rows[:, 1] + 0.2 * rng.normal(size=800)) > 0.6).astype(float)
    grid = np.linspace(-0.5, 1.5, 200)

    def risen(falling):
        forest = Q.boosted(rows, good, falling)
        lines = [forest.raw(np.column_stack([grid, np.full(200, a), np.full(200, b)])) for a, b in rng.uniform(size=(40, 2))]
        return max(np.diff(line).max() for line in lines)

    assert risen([]) > 0.01
    assert risen([0]) <= 1e-9


def test_kept_needs_both_and_no_labels_keep_what_passes(spark, docs):
    rows = [(i, t) for i, t in enumerate(CASES)] + [(1, ""), (None, "a b")]
    table = docs(rows, extra="n_words")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = Q.judged(table, labels, "doc_id", F.lit(True)).collect()
    texts = dict(rows)
    assert len(got) == len(rows)
    for r in got:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == failed(want[0], want[4]) and r.kept == (not r.base_failed) and r.score == 1


def test_labels_that_repeat_miss_or_are_null(spark, docs):
    clean = [(i, " ".join(f"word{i * j % 97}" for j in range(1, 60))) for i in range(1, 41)]
    noisy = [(i, " ".join(f"w{i * j % 89}###" for j in range(1, 60))) for i in range(41, 81)]
    given = [(i, 1) for i, _ in clean] + [(i, 0) for i, _ in noisy] + [(41, 1), (None, 0), (1, None), (999, 0)]
    labels = spark.createDataFrame(given, "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in Q.judged(docs(clean + noisy), labels, "doc_id", F.lit(True)).collect()}
    assert got == {i: True for i, _ in clean} | {i: False for i, _ in noisy}


def test_empty_table(spark, docs):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.judged(docs([]), labels, "doc_id", F.lit(True)).count() == 0


def test_query_and_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = QUERIES["op11_quality_rules"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == failed(want[0], want[4]) and not (r.kept and r.base_failed)
    import zlib

    held = [r for r in got if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and not r.base_failed]
    assert len(held) > 30 and sum(r.kept == (good[r.doc_id] == 1) for r in held) / len(held) > 0.95


@pytest.mark.parametrize("window", [2, 4, 8])
def test_windows_of_other_lengths(window):
    rng = np.random.default_rng(window)
    codes, offsets = rng.integers(0, 3, 300), np.array([0, 0, 5, 120, 120, 300])
    want = []
    for a, b in zip(offsets, offsets[1:]):
        seen = Counter(tuple(codes[i : i + window]) for i in range(a, b - window + 1))
        want.append(len({j for i in range(a, b - window + 1) if seen[tuple(codes[i : i + window])] > 1 for j in range(i, i + window)}))
    assert Q.repeated_words(codes, offsets, window).tolist() == want
