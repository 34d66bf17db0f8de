import hashlib

from tallyloom.llm import fingerprints
from tallyloom.llm.queries import QUERIES


def shingles(text, size=5):
    words = [w for w in text.replace("\t", " ").replace("\n", " ").split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else {tuple(words)} - {()}


def likeness(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def expected(rows):
    """Edited texts and true likenesses by brute force: ``(id, text, edited, next)`` by ascending id."""
    rows = sorted((i, t or "") for i, t in rows)
    for k, (i, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        quarter = len(text) // 4
        yield i, text, text[: len(text) - quarter] + following[:quarter], following


def compare(got, rows):
    got = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    errors = []
    for i, text, edited, following in expected(rows):
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert (r.fingerprint == r.edited_fingerprint) == (r.near_edited == 1.0)
        if text == following:
            assert r.near_next == 1.0
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            assert 0 <= near <= 1
            errors.append(near - likeness(text, other))
    assert max(map(abs, errors)) < 0.17
    assert abs(sum(errors) / len(errors)) < 0.01
    equal = {}
    for i, text, _, _ in expected(rows):
        assert equal.setdefault(text, got[i].fingerprint) == got[i].fingerprint


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    compare(QUERIES["op1_document_fingerprints"](spark, sf).collect(), rows)


def test_odd_texts(spark, docs):
    rows = [(1, None), (2, ""), (3, "a"), (4, "a b c d"), (5, "a b c d"), (9, " \n\t"), (7, "é\U0001F600x" * 7), (8, "one two three four five six " * 400)]
    compare(fingerprints.edited_fingerprints(docs(rows, "place")).collect(), rows)


def test_shared_and_missing_ids(spark, docs):
    rows = [(None, "a b c d e f"), (1, "x y z w v u"), (1, "p q r s t u"), (2, "a b c d e f")]
    got = fingerprints.edited_fingerprints(docs(rows, "text_hash")).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in got) == [(0, 11), (1, 11), (1, 11), (2, 11)]
    # After the last id comes the row without one; its text equals that of id 2.
    assert next(r.near_next for r in got if r.doc_id == 2) == 1.0


def test_single_and_empty(spark, docs):
    one = fingerprints.edited_fingerprints(docs([(4, "abcdefgh")])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.edited_fingerprints(docs([])).collect() == []
