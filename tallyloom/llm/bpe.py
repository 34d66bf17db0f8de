"""Byte-level BPE: recursive DuckDB queries contract the pieces of each partition, an ordered aggregation decodes.

The pattern cuts the texts into pieces in the JVM. A task encodes the distinct pieces of its rows: each is a row
``(word, tokens)``, a character for each token, whose pairs join the merge table; each step of the recursion contracts, in
every word, the leftmost pair of smallest rank, until no pair is left. Pieces that are tokens themselves are taken whole.
Pieces of many bytes would take a step per merge, so there the rows are ``(word, position, token)`` and a step also contracts
the later occurrences of that pair, when no merge of the new token has a smaller rank and the order therefore cannot matter.

Null text counts as empty; an empty text has no tokens and decodes to no bytes. Repeated rows are encoded each; columns of
other names are not read. A piece of any length is encoded whole: a recursion that reaches its bound of rows is taken up
again from its last step.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import settle
from .common import joined, short_batches, slices, text_of, tidied

# Rows that a recursion over long pieces may make, characters that one over other pieces may make and bytes it begins with,
# bytes of a long piece, pieces and tokens handled together, and encodings a worker remembers.
RECURSION_ROWS = 600_000
RECURSION_CHARS = 8_000_000
SHORT_BYTES = 150_000
LONG_PIECE = 255
SLICE_PIECES = 150_000
DECODED = 100_000
REMEMBERED = 100_000
# Rows handed to Python at a time.
ROWS = 500

_FIRST = """
  SELECT i.w, i.p, i.t, 0 AS step, m.id, m.safe
  FROM (SELECT w, p, t, lead(t) OVER (PARTITION BY w ORDER BY p) AS n FROM pieces) i
  LEFT JOIN merges m ON m.l = i.t AND m.r = i.n"""

# One pair per word and step. A word is written with a character for each token, so that a step makes one row of a word.
LEFTMOST = """
WITH RECURSIVE r AS (
  SELECT w, s, 0 AS step FROM pieces
  UNION ALL
  SELECT w, left(s, i - 1) || chr(b + 1 + 2048 * CAST(b >= 55295 AS INTEGER)) || substr(s, i + 2), step + 1
  FROM (
    SELECT r.w, s, step, CAST(k & 4294967295 AS INTEGER) AS i, CAST(k >> 32 AS INTEGER) AS b
    FROM r JOIN (
      SELECT w, min((rank << 32) | i) AS k
      FROM (SELECT w, s, unnest(range(1, length(s))) AS i FROM r WHERE step < $steps)
      JOIN pairs ON pair = substr(s, CAST(i AS INTEGER), 2) GROUP BY w) g ON g.w = r.w))
SELECT w, arg_max(s, step) AS s, max(step) = $steps AS more FROM r GROUP BY w"""
# The same characters for the merge table: no token has the character 0 or a surrogate.
_PAIRS = """
CREATE TABLE pairs AS SELECT chr(l + 1 + 2048 * CAST(l >= 55295 AS INTEGER)) || chr(r + 1 + 2048 * CAST(r >= 55295 AS INTEGER)) AS pair,
  CAST(id AS BIGINT) AS rank FROM merges"""

# Every occurrence of the pair, left to right, where that gives the same tokens.
TOGETHER = f"""
WITH RECURSIVE r AS ({_FIRST}
  UNION ALL
  SELECT s.w, s.p, s.t, s.step, m.id, m.safe
  FROM (
    SELECT w, p, step + 1 AS step, CASE WHEN hit THEN b ELSE t END AS t, coalesce(lag(hit) OVER o, false) AS gone,
           CASE WHEN hit THEN (CASE WHEN lead(hit, 2) OVER o THEN b ELSE lead(t, 2) OVER o END)
                ELSE (CASE WHEN lead(hit) OVER o THEN b ELSE lead(t) OVER o END) END AS n
    FROM (
      SELECT w, p, t, step, b, c AND CASE
               WHEN safe THEN (i - coalesce(last_value(CASE WHEN NOT c THEN i END IGNORE NULLS) OVER u, 0)) % 2 = 1
               ELSE count(CASE WHEN c THEN 1 END) OVER u = 1 END AS hit
      FROM (
        SELECT *, id IS NOT DISTINCT FROM b AS c
        FROM (SELECT w, p, t, step, id, safe, row_number() OVER (PARTITION BY w ORDER BY p) AS i,
                     min(id) OVER (PARTITION BY w) AS b FROM r WHERE step < $steps)
        WHERE b IS NOT NULL)
      WINDOW u AS (PARTITION BY w ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    WINDOW o AS (PARTITION BY w ORDER BY p)) s
  LEFT JOIN merges m ON m.l = s.t AND m.r = s.n
  WHERE NOT s.gone)
"""
_LAST = "SELECT w, p, t, max(id) OVER (PARTITION BY w) IS NOT NULL AS more FROM r JOIN (SELECT w, max(step) AS step FROM r GROUP BY w) USING (w, step) ORDER BY w, p"

DECODE = "SELECT list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocabulary USING (id)"


def read_ranks(path: str) -> list[bytes]:
    """Lines of a rank file: a token in base64 and its rank. The file is a part of the installed tokenizer package."""
    with open(path, "rb") as lines:
        pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, lines))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    return [token for _, token in pairs]


def merge_table(tokens: list[bytes]) -> pa.Table:
    """All pairs of tokens whose bytes together are a token. ``safe``: no merge of the new token has a smaller rank."""
    rank = {token: i for i, token in enumerate(tokens)}
    rows = [
        (rank[token[:k]], rank[token[k:]], i)
        for i, token in enumerate(tokens)
        for k in range(1, len(token))
        if token[:k] in rank and token[k:] in rank
    ]
    lr = np.array(rows, np.int32).reshape(-1, 3)
    least = np.full(len(tokens), len(tokens), np.int32)
    for side in (0, 1):
        np.minimum.at(least, lr[:, side], lr[:, 2])
    return pa.table({"l": lr[:, 0], "r": lr[:, 1], "id": lr[:, 2], "safe": least[lr[:, 2]] > lr[:, 2]})


class Codec:
    """Encoder and decoder of one task's process: an in-memory database with the merge table and the vocabulary."""

    def __init__(self, tokens: list[bytes], merges: pa.Table):
        self.tokens = tokens
        rank = {token: i for i, token in enumerate(tokens)}
        self.byte = np.array([rank[bytes([b])] for b in range(256)], np.int32)
        # Ids of a piece as the bytes of int32 values: tokens, and pieces met before.
        every = np.arange(len(tokens), dtype=np.int32).tobytes()
        self.known: dict[bytes, bytes] = {token: every[4 * i : 4 * i + 4] for token, i in rank.items()}
        self.room = len(self.known) + REMEMBERED
        self.db = duckdb.connect(":memory:")
        self.db.execute("SET threads = 1; SET memory_limit = '500MB'; SET temp_directory = ''")
        vocabulary = pa.table({"id": np.arange(len(tokens), dtype=np.int32), "bytes": pa.array(tokens, pa.binary())})
        for name, data in (("merges", merges), ("vocabulary", vocabulary)):
            self.db.register("given", data)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.db.execute(_PAIRS)
        signs = self.byte + 1 + 2048 * (self.byte >= 55295)
        self.sign, self.sign_bytes = signs.astype("<u4"), np.array([len(chr(x).encode()) for x in signs.tolist()], np.int32)
        self.length = np.fromiter(map(len, tokens), np.int64, len(tokens))

    def _contract_short(self, words: list[bytes]) -> list[bytes]:
        out: list = [None] * len(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        chars = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.append(0, np.cumsum(self.sign_bytes[flat])[chars - 1]).astype(np.int32)
        text = self.sign[flat].tobytes().decode("utf-32-le").encode()
        signs = pa.Array.from_buffers(pa.string(), len(words), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(text)])
        w = np.arange(len(words), dtype=np.int32)
        while len(w):
            steps = max(4, RECURSION_CHARS // pc.sum(pc.utf8_length(signs)).as_py())
            self.db.register("pieces", pa.table({"w": w, "s": signs}))
            got = self.db.sql(LEFTMOST.replace("$steps", str(steps))).to_arrow_table().combine_chunks()
            self.db.unregister("pieces")
            more = got["more"].combine_chunks()
            done = got.filter(pc.invert(more))
            sizes = 4 * pc.utf8_length(done["s"]).to_numpy().astype(np.int64)
            ends = np.cumsum(sizes)
            flat = np.frombuffer(joined(done["s"].combine_chunks())[0].decode().encode("utf-32-le"), "<u4").astype(np.int32)
            ids = (flat - 1 - 2048 * (flat >= 0xE000)).astype(np.int32).tobytes()
            for word, start, end in zip(done["w"].to_numpy().tolist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                out[word] = ids[start:end]
            left = got.filter(more)
            w, signs = left["w"].to_numpy(), left["s"].combine_chunks()
        return out

    def _contract_long(self, words: list[bytes]) -> list[bytes]:
        sizes = np.array([len(w) for w in words], np.int64)
        flat = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        w = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
        # Positions run on over the words, so a position names its word too.
        p = np.arange(len(flat), dtype=np.int32)
        out: list = [None] * len(words)
        while len(w):
            self.db.register("pieces", pa.table({"w": w, "p": p, "t": flat}))
            steps = max(4, RECURSION_ROWS // len(w))
            left = self.db.sql((TOGETHER + _LAST).replace("$steps", str(steps))).to_arrow_table()
            self.db.unregister("pieces")
            w, p, flat, more = (left[c].to_numpy() for c in ("w", "p", "t", "more"))
            ends = np.flatnonzero(np.diff(w, append=-1)) + 1
            starts = np.append(0, ends[:-1])
            done = ~more[starts]
            ids = flat.astype(np.int32).tobytes()
            for word, start, end in zip(w[starts[done]].tolist(), (4 * starts[done]).tolist(), (4 * ends[done]).tolist(), strict=True):
                out[word] = ids[start:end]
            w, p, flat = w[more], p[more], flat[more]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Token ids of distinct pieces."""
        return [np.frombuffer(ids, np.int32) for ids in self._coded(pieces)]

    def _coded(self, pieces: list[bytes]) -> list[bytes]:
        """Token ids of distinct pieces, each as the bytes of int32 values."""
        out = list(map(self.known.get, pieces))
        short, long = [], []
        for i, ids in enumerate(out):
            if ids is None:
                (long if len(pieces[i]) > LONG_PIECE else short).append(i)
        for group, contract, most in ((short, self._contract_short, SHORT_BYTES), (long, self._contract_long, 150_000)):
            sizes = np.array([len(pieces[i]) for i in group], np.int64)
            for a, b in slices(sizes, most):
                some = group[a:b]
                for i, ids in zip(some, contract([pieces[i] for i in some]), strict=True):
                    out[i] = ids
                    if len(self.known) < self.room and group is short:
                        self.known[pieces[i]] = ids
        return out

    def encode(self, pieces: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as flat pieces with the texts' offsets: flat ids and the texts' offsets in them."""
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        coded = pieces.dictionary_encode()
        codes = coded.indices.to_numpy()
        data, at = joined(coded.dictionary)
        ids = self._coded([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.int32), np.cumsum(sizes) - sizes
        n = sizes[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        where = np.arange(ends[-1]) + np.repeat(first[codes] - ends[:-1], n)
        return flat[where], ends[offsets]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Bytes of texts given as flat ids with the texts' offsets."""
        out = [b""] * (len(offsets) - 1)
        sizes = np.diff(offsets)
        for a, b in slices(sizes, DECODED):
            some = ids[offsets[a] : offsets[b]]
            self.db.register("tokens", pa.table({"pos": np.arange(len(some), dtype=np.int32), "id": some}))
            parts = self.db.sql(DECODE).to_arrow_table()["parts"].combine_chunks()
            self.db.unregister("tokens")
            if len(some):
                flat = pc.binary_join(parts.cast(pa.list_(pa.binary())), pa.scalar(b"", pa.binary()))[0].as_py()
                at = np.append(0, np.cumsum(self.length[some]))[offsets[a : b + 1] - offsets[a]].tolist()
                out[a:b] = [flat[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        return out


_codecs: dict[str, Codec] = {}


def _codec(key: str, tokens: list[bytes], merges: pa.Table) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(tokens, merges)
    return _codecs[key]


# Classes whose members depend on the Unicode version of whoever reads the pattern.
CLASSES = ("\\p{L}", "\\p{N}", "\\s")
SURROGATES = (0xD800, 0xE000)


def _ranges(points: np.ndarray) -> str:
    """Code points as ranges of a character class."""
    if not len(points):
        return ""
    cuts = np.flatnonzero(np.diff(points) > 1)
    firsts, lasts = points[np.append(0, cuts + 1)], points[np.append(cuts, len(points) - 1)]
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True))


@functools.cache
def library_members(name: str) -> np.ndarray:
    """The code points that the tokenizer library counts to a class: what a pattern of that class alone finds among all."""
    import tiktoken  # only where queries are planned; tasks do without it

    every = "".join(map(chr, (*range(SURROGATES[0]), *range(SURROGATES[1], 0x110000))))
    bytes_only = {bytes([b]): b for b in range(256)}
    reader = tiktoken.Encoding(name="class", pat_str=name, mergeable_ranks=bytes_only, special_tokens={})
    return np.array([ord(c) for c in reader.decode(reader.encode_ordinary(every))], np.int64)


def session_members(spark: SparkSession) -> dict[str, np.ndarray]:
    """The code points that the session's Java counts to each class; the table has one row per code point."""
    points = spark.range(0x110000).where(~F.col("id").between(SURROGATES[0], SURROGATES[1] - 1))
    char = F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32")
    found = points.select("id", *[char.rlike(f"(?U)^{name}\\z").alias(f"c{i}") for i, name in enumerate(CLASSES)]).where("c0 OR c1 OR c2").toArrow()
    return {name: np.sort(found["id"].filter(found[f"c{i}"]).to_numpy()) for i, name in enumerate(CLASSES)}


_patterns: dict[tuple[str, str], str] = {}


def session_pattern(spark: SparkSession, pattern: str) -> str:
    """The pattern for the session's Java with the classes of the tokenizer library, whatever Unicode versions they know.

    Code points that only the library counts to a class are written behind it, after the least of them, so that no other
    character is held against them one by one; a class that has too many in Java is written out as ranges.
    """
    key = (spark.sparkContext.applicationId, pattern)
    if key in _patterns:
        return _patterns[key]
    members = session_members(spark)
    written = {}
    for name in CLASSES:
        theirs, ours = library_members(name), members[name]
        more = np.setdiff1d(theirs, ours)
        if len(np.setdiff1d(ours, theirs)):
            written[name] = _ranges(theirs)
        else:
            written[name] = name + (f"[\\x{{{more[0]:X}}}-\\x{{10FFFF}}&&[{_ranges(more)}]]" if len(more) else "")
    out, inside, i = [], False, 0
    while i < len(pattern):
        name = next((c for c in CLASSES if pattern.startswith(c, i)), None)
        if name:
            out.append(written[name] if inside else f"[{written[name]}]")
            i += len(name)
            continue
        step = 2 if pattern[i] == "\\" else 1
        inside = {"[": True, "]": False}.get(pattern[i], inside) if step == 1 else inside
        out.append(pattern[i : i + step])
        i += step
    _patterns[key] = "(?U)" + "".join(out)
    return _patterns[key]


def with_pieces(rows: DataFrame, pattern: str, text: str = "text") -> DataFrame:
    """Rows with ``pieces``, the matches of the pattern in the whole text, its classes as the tokenizer library has them."""
    own = session_pattern(rows.sparkSession, pattern)
    return rows.withColumn("pieces", F.regexp_extract_all(text_of(F.col(text)), F.lit(own), F.lit(0)))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, pa.Array, np.ndarray]]:
    """Slices of a batch's rows with their flat pieces and offsets."""
    lists = batch.column(batch.num_columns - 1)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values
    for a, b in slices(np.diff(offsets), SLICE_PIECES):
        yield a, b, flat.slice(offsets[a], offsets[b] - offsets[a]), offsets[a : b + 1] - offsets[a]


# What can be asked of the encoding of a text.
COLUMNS = {
    "n_tokens": T.LongType(),
    "ids": T.ArrayType(T.IntegerType()),
    "decoded": T.BinaryType(),
    "ids_sha256": T.StringType(),
    "decoded_sha256": T.StringType(),
}


def encode(spark: SparkSession, rows: DataFrame, keep: list[str], path: str, pattern: str, columns: list[str]) -> DataFrame:
    """``keep`` columns of every row and, of its whole text, the asked ``COLUMNS``; what is decoded comes from the ids."""
    tokens = read_ranks(path)
    sent = spark.sparkContext.broadcast((tokens, merge_table(tokens)))
    given = with_pieces(rows.select(*keep, F.col("text").alias("__text")), pattern, "__text").select(*keep, F.col("pieces").alias("__pieces"))
    schema = given.select(*keep).schema
    for name in columns:
        schema = schema.add(name, COLUMNS[name])
    decode = "decoded" in columns or "decoded_sha256" in columns

    def made(ids: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> Iterator[pa.Array]:
        wide = ids.astype("<u4")
        for name in columns:
            if name == "n_tokens":
                yield pa.array(np.diff(ends))
            elif name == "ids":
                yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
            elif name == "decoded":
                yield pa.array(texts, pa.binary())
            elif name == "ids_sha256":
                yield pa.array([hashlib.sha256(wide[s:e]).hexdigest() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.string())
            else:
                yield pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, *sent.value)
        for batch in batches:
            for a, b, pieces, offsets in _runs(batch):
                ids, ends = codec.encode(pieces, offsets)
                new = made(ids, ends, codec.decode(ids, ends) if decode else [])
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns[:-1]), *new], names=[*keep, *columns])

    with short_batches(spark, ROWS):
        return settle(given.mapInArrow(tidied(work), schema), "encoded")
