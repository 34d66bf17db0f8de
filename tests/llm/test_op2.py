import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import class_lm
from tallyloom.llm.common import fold
from tallyloom.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return (text or "").translate(LOWER).encode().split()


def base(rows):
    """Known tokens and base score of every row, and the training tokens, by plain counting."""
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1 for k, _ in rows]
    count = Counter()
    for (_, text), h in zip(rows, held, strict=True):
        if not h:
            count.update([*words(text), b""])
    total, kinds = sum(count.values()), len(count)
    for (k, text), h in zip(rows, held, strict=True):
        tokens = [*words(text), b""]
        score = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in tokens)
        yield k, h, len(tokens), sum(count[t] > 0 for t in tokens), total, score


def compare(got, rows):
    def order(x):
        return (x[0] is None, x[0] or 0, x[2], round(x[5], 6))

    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=order)
    for a, b in zip(mine, sorted(base(rows), key=order), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9)
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op2_class_lm"](spark, sf).collect()
    compare(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_odd_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "A a\tb\x0bc"), (3, "A a\tb\x0bc"), (None, "é É x"), (6, " \n "), (9, "unseen words " * 3000), (11, "a b a b")]
    compare(class_lm.model_scores(spark, docs(rows, "n").withColumn("train", fold(F.col("doc_id")) != 1)).collect(), rows)


def test_empty(spark, docs):
    assert class_lm.model_scores(spark, docs([]).withColumn("train", F.lit(True))).collect() == []


def test_probabilities_sum_to_one(spark, docs):
    """After any word, the known words, the end and one unseen word per unit share all probability."""
    rows = [(i, t) for i, t in enumerate(["a b c a b", "a c b", "d e a b", "b c"])]
    table = class_lm.chunks(docs(rows).withColumn("train", F.lit(True)), "train")
    counts = class_lm.word_counts(table)
    model = class_lm.fit(spark, table, counts)
    n = {r.word: r.n for r in counts.collect()}
    assert n == {"a": 4, "b": 5, "c": 3, "d": 1, "e": 1, "": 4}
    for c in range(class_lm.CLASSES):
        assert (10.0 ** model.log_transition[c]).sum() == pytest.approx(1)
        inside = 10.0 ** model.log_unit[model.classes == c]
        assert len(inside) == 0 or inside.sum() == pytest.approx(1)
    units = class_lm.units_of(pa.array(["a", "b", "zzz"]), model.frequent)
    assert units[0] <= class_lm.WORDS < units[2]


def test_exchange_raises_the_likelihood():
    """Two groups of units that only follow one another end in classes of their own."""
    rng = np.random.default_rng(0)
    size = class_lm.UNITS
    pairs = np.zeros((size, size))
    for _ in range(3000):
        a, b = rng.integers(0, 6, 2) * 2
        pairs[a, b + 1] += 1
        pairs[b + 1, a] += 1
    classes = np.zeros(size, np.int64)
    classes[:12] = rng.integers(0, 2, 12)

    def beside(classes):
        left, right = np.zeros((size, class_lm.CLASSES)), np.zeros((size, class_lm.CLASSES))
        for c in range(class_lm.CLASSES):
            left[:, c] = pairs[classes == c].sum(0)
            right[:, c] = pairs[:, classes == c].sum(1)
        return left, right, np.diag(pairs).copy()

    before = class_lm.likelihood(class_lm._table(beside(classes)[1], classes))
    for k in range(6):
        classes = class_lm.exchanged(*beside(classes), classes, np.arange(k % 3, 12, 3))
    after = class_lm.likelihood(class_lm._table(beside(classes)[1], classes))
    assert after > before
    assert not set(classes[0:12:2]) & set(classes[1:12:2])


def test_words_outside_the_frequent_ones_get_classes_of_their_own(spark, docs):
    """Rare words that share an ending but stand in other places part; every round of words raises the likelihood or is the last."""
    rng = np.random.default_rng(5)
    nouns, verbs = [f"n{i:02d}same" for i in range(20)], [f"v{i:02d}same" for i in range(20)]
    # As many nouns and verbs beside these, each more frequent, as fill the frequent words.
    half = class_lm.WORDS // 2 - 1
    texts = [" ".join(f"the a{i} will b{j}" for i, j in zip(rng.permutation(half), rng.permutation(half), strict=True)) for _ in range(40)]
    texts += [" ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)}" for _ in range(30)) for _ in range(10)]
    table = class_lm.chunks(docs(list(enumerate(texts))).withColumn("train", F.lit(True)), "train")
    counts = class_lm.word_counts(table)
    model = class_lm.fit(spark, table, counts)
    found = {r.word: r["class"] for r in model.words.collect()}
    assert set(found) == {*nouns, *verbs}
    assert not {found[w] for w in nouns} & {found[w] for w in verbs}
    assert all(b > a for a, b in zip(model.word_rounds, model.word_rounds[1:-1]))
    inside = sum((r.n + class_lm.ADDED) * 10.0 ** -model.log_size[r["class"]] for r in model.words.collect())
    assert inside + (10.0**model.log_unit).sum() == pytest.approx(len(set(model.classes) | set(found.values())))


def test_gains_of_many_words_are_those_of_each_alone():
    """The class of every word is the one of greatest gain by plain sums over all classes; some words stand beside themselves."""
    rng = np.random.default_rng(3)
    words = rng.choice(200, 4000, p=1 / np.arange(1, 201) / (1 / np.arange(1, 201)).sum())
    classes = rng.integers(0, class_lm.CLASSES, 201)
    seq = np.concatenate([words, [200, 0, 200]])
    c, size = classes[seq], class_lm.CLASSES
    m, left, right = np.zeros((size, size)), np.zeros((201, size)), np.zeros((201, size))
    np.add.at(m, (c[:-1], c[1:]), 1)
    np.add.at(left, (seq[1:], c[:-1]), 1)
    np.add.at(right, (seq[:-1], c[1:]), 1)
    f, diag = class_lm._f, np.arange(size)
    for u, b in enumerate(class_lm.gains(left, right, classes, m)):
        a, r, l = classes[u], right[u], left[u]
        base = m.copy()
        base[a] -= r
        base[:, a] -= l
        base = np.maximum(base, 0)
        d, rows, cols = base[diag, diag], base.sum(1), base.sum(0)
        gain = (f(base + r) - f(base)).sum(1) + (f(base + l[:, None]) - f(base)).sum(0) + f(d + r + l) - f(d + r) - f(d + l) + f(d)
        gain -= f(rows + r.sum()) - f(rows) + f(cols + l.sum()) - f(cols)
        assert gain[b] == pytest.approx(gain.max(), abs=1e-6)


def test_rounds_write_less_than_their_texts(spark, docs, tmp_path):
    """What a scoring leaves in the shared folder does not grow with the rounds: tables of earlier rounds are deleted."""
    from pathlib import Path

    from tallyloom.session import shared_dir

    rng = np.random.default_rng(8)
    shared = Path(shared_dir(spark).removeprefix("file:"))
    before = set(shared.iterdir())
    texts = [" ".join(f"w{i}" for i in rng.zipf(1.3, 400) % 9000) for _ in range(60)]
    rows = list(enumerate(texts))
    compare(class_lm.model_scores(spark, docs(rows).withColumn("train", fold(F.col("doc_id")) != 1)).collect(), rows)
    left = [p.name.rsplit("-", 1)[0] for p in set(shared.iterdir()) - before]
    assert left.count("contexts") == left.count("sequences") == left.count("packed") == left.count("bigrams") == 0
    assert "chunks" in left and "scores" in left


def test_counts_beyond_a_byte_and_several_parts(spark, docs, monkeypatch):
    """Contexts that occur more often than a byte holds, added up over chunks, are those of plain counting."""
    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 20_000)
    half = class_lm.WORDS // 2
    texts = [" ".join(f"a{i} b{i}" for i in range(half)) for _ in range(3)] * 400 + ["rare1 a1 " * 700 + "rare2 b2 rare2"]
    table = class_lm.chunks(docs(list(enumerate(texts))).withColumn("train", F.lit(True)), "train")
    counts = class_lm.word_counts(table)
    frequent = pa.array([f"{x}{i}" for i in range(half) for x in "ab"])
    classes = np.arange(class_lm.UNITS) % class_lm.CLASSES
    found, m = class_lm.contexts(class_lm.sequences(table, frequent, classes))
    assert m.sum() == counts.agg(F.sum("n")).first()[0]
    got = {}
    for r in found.collect():
        for word, _, beside in zip(*(x.to_pylist() for x in class_lm._unpacked(bytes(r["data"]))), strict=True):
            for side, n in np.frombuffer(beside, np.uint8).reshape(-1, 2).tolist():
                got[word, side] = got.get((word, side), 0) + n
    unit = {w: int(u) for w, u in zip(["rare1", "rare2", "a1", "b2"], class_lm.units_of(pa.array(["rare1", "rare2", "a1", "b2"]), frequent), strict=True)}
    c = {w: int(classes[u]) for w, u in unit.items()}
    side = class_lm.CLASSES
    expect = {}
    line = ["", *texts[-1].split(), ""]
    for a, w, b in zip(line, line[1:], line[2:]):
        if w.startswith("rare"):
            for key in (c.get(a, 0), side + c.get(b, 0)):
                expect[w, key] = expect.get((w, key), 0) + 1
    assert got == expect


def test_rare_words_take_their_terms_from_tables(monkeypatch):
    """Logarithms are taken of what is beside a word and its own class, not of all classes; the classes are those of all."""
    rng = np.random.default_rng(3)
    n = 400
    left, right = np.zeros((2, n, class_lm.CLASSES))
    left[np.arange(n), rng.integers(0, class_lm.CLASSES, n)] = 1
    right[np.arange(n), rng.integers(0, class_lm.CLASSES, n)] = 1
    own = rng.integers(0, class_lm.CLASSES, n)
    m = rng.integers(1, 1000, (class_lm.CLASSES, class_lm.CLASSES)).astype(float)
    known = class_lm.tables(m)
    monkeypatch.setattr(class_lm, "LOST", 0)
    whole = class_lm.gains(left, right, own, m)
    monkeypatch.undo()
    seen, real = [], class_lm._f
    monkeypatch.setattr(class_lm, "_f", lambda x: seen.append(np.size(x)) or real(x))
    assert class_lm.gains(left, right, own, m, known).tolist() == whole.tolist()
    assert sum(seen) < class_lm.CLASSES * n


def test_words_travel_packed_by_part(spark, docs, monkeypatch):
    """Words go through Spark as packed parts, with their counts, and not as a row or an array element each."""
    monkeypatch.setattr(class_lm, "CHUNK_BYTES", 20_000)
    monkeypatch.setattr(class_lm, "PART_ROWS", 100)
    monkeypatch.setattr(class_lm, "PARTS", 4)
    rows = [(i, " ".join([*(f"w{i * 70 + j}" for j in range(300)), "é" * (i + 1), "long" * (i * 9 + 1)])) for i in range(40)]
    table = class_lm.chunks(docs(rows).withColumn("train", F.lit(True)), "train")
    assert dict(table.dtypes)["words"] == "binary"
    parts = class_lm.parts_of(table)
    assert parts > class_lm.PARTS
    expect = Counter(w for _, t in rows for w in t.split()) + Counter({"": len(rows)})
    counts = class_lm.word_counts(table)
    assert {r.word: r.n for r in counts.collect()} == expect
    some = sorted(expect)
    part, order = class_lm.dealt(pa.array(some), parts)
    of = dict(zip((some[i] for i in order), part.tolist(), strict=True))
    alone = [int(class_lm.dealt(pa.array([w]), parts)[0][0]) for w in some]
    assert [of[w] for w in some] == alone and len(set(alone)) > parts / 2
    model = class_lm.fit(spark, table, counts)
    assert model.words.collect() and all(r.n == expect[r.word] for r in model.words.collect())
    unread = {(r.word, r.n) for r in counts.collect()} - {(r.word, r.n) for r in model.words.collect()}
    assert {w for w, _ in unread} == {"", *model.frequent.to_pylist()}
