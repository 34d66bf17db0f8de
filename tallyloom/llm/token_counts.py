"""Edit-aware token counts: a segment tree per document whose leaves are runs of pre-tokens.

A text is cut where a letter is followed by a space and a letter: there a pre-token ends whatever stands around it, so the
runs between cuts can be encoded apart. The leaves of the tree are such runs of at least ``LEAF`` characters with their
numbers of characters and tokens; every inner node holds the sums of its two children. An edit finds the leaves it touches by
their characters, takes in a neighbour where it comes so near to a cut that the cut may go, encodes only these leaves anew,
and updates the sums above them. When a leaf has outgrown its size, the tree is balanced again from the leaves, without
encoding.

Null text counts as empty; it has no tokens, and edits apply to it as to an empty text. Positions count code points and are
those of the text as earlier edits left it; they are cut to the text. Repeated rows are counted each.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of

LEAF = 256
# A leaf that grew beyond this many characters is cut again.
GROWN = 4 * LEAF
SAFE_CUT = regex.compile(r"(?<=\p{L})(?= \p{L})")

Edit = tuple[int, int, str]


def cut(text: str) -> list[str]:
    """The text in runs of at least ``LEAF`` characters that end at a safe cut; the last run may be shorter."""
    out, start = [], 0
    while start < len(text):
        found = SAFE_CUT.search(text, min(start + LEAF, len(text)))
        end = found.start() if found else len(text)
        out.append(text[start:end])
        start = end
    return out


class SegmentTree:
    """Sums of characters and tokens over the leaves of one text."""

    def __init__(self, text: str, count: Callable[[list[str]], list[int]]):
        self.count = count
        self.encoded = 0
        leaves = cut(text)
        self._build(leaves, self._tokens(leaves))

    def _tokens(self, leaves: list[str]) -> list[int]:
        self.encoded += sum(map(len, leaves))
        return self.count(leaves) if leaves else []

    def _build(self, leaves: list[str], tokens: list[int]) -> None:
        self.leaves = leaves
        self.size = 1 << max(0, len(leaves) - 1).bit_length()
        self.chars = [0] * (2 * self.size)
        self.tokens = [0] * (2 * self.size)
        self.chars[self.size : self.size + len(leaves)] = map(len, leaves)
        self.tokens[self.size : self.size + len(leaves)] = tokens
        for node in range(self.size - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a position, and the leaf's first position; the last leaf for the end of the text."""
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if position >= before + self.chars[node] and self.chars[node + 1]:
                before += self.chars[node]
                node += 1
        return node - self.size, before

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters ``start`` to ``end``."""
        start = min(max(start, 0), self.n_chars)
        end = min(max(end, start), self.n_chars)
        if not self.leaves:
            leaves = cut(replacement)
            self._build(leaves, self._tokens(leaves))
            return
        first, first_at = self._leaf_at(start)
        while first > 0 and start - first_at < 2:
            first -= 1
            first_at -= len(self.leaves[first])
        last, last_at = self._leaf_at(end)
        while last + 1 < len(self.leaves) and last_at + len(self.leaves[last]) - end < 2:
            last_at += len(self.leaves[last])
            last += 1
        old = "".join(self.leaves[first : last + 1])
        new = cut(old[: start - first_at] + replacement + old[end - first_at :])
        tokens = self._tokens(new)
        slots = last + 1 - first
        # The new runs go to the old ones' slots; the last slot takes those beyond.
        held = [new[i : i + 1] if i + 1 < slots else new[i:] for i in range(slots)]
        counts = [tokens[i : i + 1] if i + 1 < slots else tokens[i:] for i in range(slots)]
        if any(sum(map(len, h)) > GROWN and len(h) > 1 for h in held) or not all(held):
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            kept = self.tokens[self.size : self.size + len(self.leaves)]
            self._build(before + new + after, kept[:first] + tokens + kept[last + 1 :])
            return
        for slot in range(slots):
            self.leaves[first + slot] = "".join(held[slot])
            self.chars[self.size + first + slot] = len(self.leaves[first + slot])
            self.tokens[self.size + first + slot] = sum(counts[slot])
        low, high = (self.size + first) // 2, (self.size + last) // 2
        while low:
            for node in range(low, high + 1):
                self._sum(node)
            low, high = low // 2, high // 2


_encodings: dict = {}


def _counter(key: str, ranks: dict[bytes, int], pattern: str) -> Callable[[list[str]], list[int]]:
    if key not in _encodings:
        import tiktoken

        _encodings.clear()
        _encodings[key] = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    encode = _encodings[key].encode_ordinary
    return lambda leaves: [len(encode(leaf)) for leaf in leaves]


def counted(spark: SparkSession, rows: DataFrame, key: str, edits: Column, path: str, pattern: str) -> DataFrame:
    """Token counts before and after the edits of every row.

    ``edits`` is an array of structs ``start, end, text``; null means none. Returns ``key, n_chars, n_tokens, n_edits,
    edited_n_chars, edited_n_tokens, encoded_chars``, the last being the characters encoded for the edits.
    """
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    sent = spark.sparkContext.broadcast(ranks)
    names = ["n_chars", "n_tokens", "n_edits", "edited_n_chars", "edited_n_tokens", "encoded_chars"]

    def one(text: str, changes: Iterable[dict], count) -> tuple[int, ...]:
        tree = SegmentTree(text, count)
        before = (tree.n_chars, tree.n_tokens)
        tree.encoded = 0
        n = 0
        for change in changes:
            tree.edit(change["start"], change["end"], change["text"] or "")
            n += 1
        return (*before, n, tree.n_chars, tree.n_tokens, tree.encoded)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path, sent.value, pattern)
        for batch in batches:
            made = [one(t.as_py() or "", e.as_py() or (), count) for t, e in zip(batch.column(1), batch.column(2), strict=True)]
            table = np.array(made, np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, i]) for i in range(len(names)))], names=[key, *names])

    kind = dict(rows.dtypes)[key]
    given = rows.select(key, "text", edits.alias("__edits"))
    return given.mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{n} bigint" for n in names))


def sample_edits(text: Column) -> Column:
    """The edits that the query makes to every text, from the text itself: its first 20 code points are put in at a third,
    10 go at the middle, and the last tenth is replaced by the code points at the start, in upper case."""
    text = text_of(text)
    n = F.length(text)

    def change(start: Column, end: Column, new: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), new.alias("text"))

    tenth = F.floor(n / 10)
    return F.array(
        change(F.floor(n / 3), F.floor(n / 3), F.substring(text, 1, 20)),
        change(F.floor(n / 2), F.floor(n / 2) + 10, F.lit("")),
        change(n - tenth, n, F.upper(F.substr(text, F.lit(1), tenth.cast("int")))),
    )
