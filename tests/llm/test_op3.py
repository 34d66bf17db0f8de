import base64
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from tallyloom.llm import bpe
from tallyloom.llm.queries import QUERIES, RANKS

PATH = public_tokenizers.path(RANKS)


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_query(spark, sf, reference):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = QUERIES["op3_byte_bpe"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = reference.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


ODD = [
    "", None, "  a   b\n\n\x85 x \x1c y", "-" * 5000, " " * 3001 + "x", "I'll we've 'S ٣٤ ½ ²", "ab" * 700, "日本語テキスト" * 20,
    "\U0001f600" * 100, "é" * 333, "퟿\x00a", "<|endoftext|>", "aaaa" * 64 + " aaa", "\r\n\t\x0b",
]


def test_odd_texts(spark, docs, reference):
    """Null, empty, long pieces of one character and of many, white space of all kinds, characters of many bytes."""
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "no id")]
    got = bpe.encode(spark, docs(rows, "ids"), ["doc_id"], PATH, public_tokenizers.PATTERN, ["ids", "decoded"]).collect()
    assert len(got) == len(rows)
    for r, (k, text) in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id)), sorted(rows, key=lambda r: (r[0] is None, r[0])), strict=True):
        assert r.doc_id == k
        assert r.ids == reference.encode_ordinary(text or "")
        assert bytes(r.decoded) == (text or "").encode()


def test_recursion_is_taken_up_again(spark, docs, reference, monkeypatch):
    monkeypatch.setattr(bpe, "RECURSION_ROWS", 50)
    tokens = bpe.read_ranks(PATH)
    codec = bpe.Codec(tokens, bpe.merge_table(tokens))
    pieces = ["unbelievableness" * 3, "x" * 300, "strange" * 60]
    for piece, ids in zip(pieces, codec.encode_pieces([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == reference.encode_ordinary(piece)


def test_empty(spark, docs):
    assert bpe.encode(spark, docs([]), ["doc_id"], PATH, public_tokenizers.PATTERN, ["n_tokens"]).collect() == []


def test_every_code_point_has_the_ids_of_the_library(spark, docs, reference):
    """Each code point alone, doubled, and between letters, digits and spaces; many of them to a text."""
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1{chr(c)}{chr(c)}. " for c in points[i : i + 4000]) for i in range(0, len(points), 4000)]
    got = bpe.encode(spark, docs(list(enumerate(texts))).repartition(8), ["doc_id"], public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ["ids"])
    for r in got.toLocalIterator():
        assert r["ids"] == reference.encode_ordinary(texts[r.doc_id]), hex(points[r.doc_id * 4000])


def test_a_class_with_too_many_members_is_written_out(spark, monkeypatch):
    monkeypatch.setattr(bpe, "library_members", lambda name: np.array({"\\p{L}": [97, 98, 99], "\\p{N}": [49], "\\s": [32]}[name]))
    monkeypatch.setattr(bpe, "_patterns", {})
    assert bpe.session_pattern(spark, r"\p{L}+|[^\s\p{N}]\[") == "(?U)[\\x{61}-\\x{63}]+|[^\\x{20}-\\x{20}\\x{31}-\\x{31}]\\["


def test_texts_are_decoded_in_slices(reference, monkeypatch):
    """No more tokens than the bound are decoded together, but for a text that has more by itself."""
    monkeypatch.setattr(bpe, "DECODED", 10)
    tokens = bpe.read_ranks(PATH)
    codec = bpe.Codec(tokens, bpe.merge_table(tokens))
    seen = []
    real = codec.db

    class Watched:
        def __getattr__(self, name):
            return getattr(real, name)

        def register(self, name, data):
            seen.append(data.num_rows)
            return real.register(name, data)

    codec.db = Watched()
    texts = ["one two three", "", "four", "long " * 30, "", "é \U0001f600"]
    ids = [reference.encode_ordinary(t) for t in texts]
    offsets = np.cumsum([0, *map(len, ids)])
    assert codec.decode(np.concatenate(ids).astype(np.int32), offsets) == [t.encode() for t in texts]
    assert sum(seen) == offsets[-1] and all(n <= 10 or n == len(ids[3]) for n in seen)


def test_a_piece_is_one_row_of_the_recursion(reference):
    """Not a row for each of its bytes, but for pieces of many bytes."""
    tokens = bpe.read_ranks(PATH)
    codec = bpe.Codec(tokens, bpe.merge_table(tokens))
    seen = []
    real = codec.db

    class Watched:
        def __getattr__(self, name):
            return getattr(real, name)

        def register(self, name, data):
            seen.append(data.num_rows)
            return real.register(name, data)

    codec.db = Watched()
    pieces = ["unbelievableness", "strangewordish", "😀😁é", "qqxxqqzzq"]
    for piece, ids in zip(pieces, codec.encode_pieces([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == reference.encode_ordinary(piece)
    assert seen == [len(pieces)]


def test_short_pieces_are_taken_up_again(reference, monkeypatch):
    monkeypatch.setattr(bpe, "RECURSION_CHARS", 1)
    tokens = bpe.read_ranks(PATH)
    codec = bpe.Codec(tokens, bpe.merge_table(tokens))
    pieces = ["unbelievableness" * 3, "zq", "strangewordish" * 10, "x" * 255, "é" * 127]
    for piece, ids in zip(pieces, codec.encode_pieces([p.encode() for p in pieces]), strict=True):
        assert ids.tolist() == reference.encode_ordinary(piece)


def test_tokens_behind_the_surrogates():
    """Tokens of such numbers are written as characters too; here every merge is among them."""
    filler = [bytes([1, 2, 3, 4, a, b, c]) for a in range(40) for b in range(40) for c in range(40)][: 0xD7F0 - 256]
    merged = [bytes([a, b]) for a in b"abcdef" for b in b"abcdef"] + [bytes([*x, *y]) for x in (b"ab", b"cd") for y in (b"ab", b"cd", b"ef")]
    tokens = [bytes([b]) for b in range(256)] + filler + merged
    assert len(filler) + 256 < 0xD800 < len(tokens)
    codec = bpe.Codec(tokens, bpe.merge_table(tokens))
    own = tiktoken.Encoding("own", pat_str=".+", mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    pieces = ["abcdefabc", "fedcbaabab", "cdcdefefab", "aabbccddeeffab"]
    got = codec.encode_pieces([p.encode() for p in pieces])
    for piece, ids in zip(pieces, got, strict=True):
        assert ids.tolist() == own.encode_ordinary(piece)
    assert codec.decode(np.concatenate(got), np.cumsum([0, *map(len, got)])) == [p.encode() for p in pieces]


def test_a_batch_is_encoded_in_slices_of_few_pieces():
    """What a worker holds follows the slice, not the batch; a text of more pieces is a slice of its own."""
    lists = pa.array([["a", "b"] * 30_000] * 4 + [["c"] * 300_000] + [[]], pa.list_(pa.string()))
    runs = list(bpe._runs(pa.RecordBatch.from_arrays([lists], names=["pieces"])))
    assert [(a, b) for a, b, *_ in runs] == [(0, 2), (2, 4), (4, 5), (5, 6)]
    assert all(len(flat) == offsets[-1] for _, _, flat, offsets in runs)
