"""Quality rules: gradient-boosted trees over document statistics.

The statistics of every whole text are computed once, in Arrow batches, and written as numbers; texts are not read again. The
trees are fitted in numpy on the statistics of at most ``SAMPLE`` labelled documents per class (chosen by the hash of the id,
after labels and documents have met), with logistic loss and histograms of the features' values. Features in ``FALLING`` are
monotonic: a split whose right side would score above its left side is not taken, and the children of a split keep to their
side of its middle, so no document scores better for more symbols, repeats or duplicate lines. All trees are flattened into
arrays of nodes; scoring walks a batch of documents through all trees at once, a level at a time.

Null and empty texts have zero statistics and fail the base rules. A null id has no label; repeated rows are scored one by one,
and repeated labels of an id count as their smallest quality. Without labels of both classes the trees say nothing: the base
rules decide alone. An empty table gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.seeded import key_fraction, order_key
from ..session import settle
from .common import short_batches, slices, split_words

# Labelled documents of a class that fit the trees.
SAMPLE = 10_000
TREES, DEPTH, RATE, BINS = 60, 4, 0.2, 64
LEAST_ROWS, RIDGE = 5, 1.0
# Bytes of text of one vectorised step; a longer text is a step of its own.
STEP_BYTES = 4 * 2**20
# Rows handed to Python at a time.
ROWS = 500

# The counted symbols, the length of a repeated window, and the base rules.
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
FEWEST_WORDS, REPEATED_PERCENT = 20, 30

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = [
    "log_words",
    "mean_word",
    "longest_word",
    "symbols_per_word",
    "dup_line_share",
    "repeat_share",
    "same_as_before",
    "top_word_share",
    "distinct_share",
    "entropy",
    "wordless_share",
    "digit_share",
    "upper_share",
    "stop_share",
    "words_per_line",
    "ended_lines",
    "short_lines",
]
FALLING = ["symbols_per_word", "dup_line_share", "repeat_share", "same_as_before", "wordless_share"]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values between consecutive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def codes_of(values: pa.Array) -> np.ndarray:
    return pc.dictionary_encode(values).indices.to_numpy(zero_copy_only=False).astype(np.int64)


def tallies(codes: np.ndarray, doc: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per distinct (document, code): its document and count; and for every value the number of its pair."""
    pair, keys = pd.factorize(codes * n_docs + doc)
    return keys % n_docs, np.bincount(pair, minlength=len(keys)), pair


def repeated_words(codes: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Words of every document inside a window of words that occurs twice or more in it.

    Windows get exact numbers by doubling: a window is the pair of its halves.
    """
    n, n_docs = len(codes), len(offsets) - 1
    number, length = codes, 1
    while length < window and n >= 2 * length:
        number = pd.factorize(number[:-length] * np.int64(n + 1) + number[length:])[0].astype(np.int64)
        length *= 2
    covered = np.zeros(n + 1, np.int64)
    if length == window:
        doc = np.repeat(np.arange(n_docs), np.diff(offsets))
        starts = np.arange(len(number))
        starts = starts[starts + window <= offsets[1:][doc[: len(number)]]]
        _, count, pair = tallies(number[starts], doc[starts], n_docs)
        again = starts[count[pair] > 1]
        np.add.at(covered, again, 1)
        np.add.at(covered, again + window, -1)
    return sums(np.cumsum(covered[:n]) > 0, offsets)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and FEATURES of every text."""
    texts = pa.concat_arrays([pc.fill_null(texts, "")]).cast(pa.large_string())
    n = len(texts)
    offsets, words = split_words(texts, lower=False)
    n_words = np.diff(offsets)
    doc = np.repeat(np.arange(n), n_words)
    sizes = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = codes_of(words)
    of, count, _ = tallies(codes, doc, n)

    lists = pc.split_pattern(texts, "\n")
    lines, line_offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    line_doc = np.repeat(np.arange(n), np.diff(line_offsets))
    bare = pc.ascii_trim_whitespace(lines)
    full = pc.greater(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)
    line_of, line_count, _ = tallies(codes_of(lines)[full], line_doc[full], n)
    n_lines = np.bincount(line_doc[full], minlength=n)
    ended = pc.match_substring_regex(bare, "[.!?:;\"»”]$").to_numpy(zero_copy_only=False)
    line_words = pc.count_substring_regex(bare, "[ \\t-\\r]+").to_numpy(zero_copy_only=False) + 1

    counts = {
        "n_words": n_words,
        "word_chars": sums(sizes, offsets),
        "n_symbols": pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_dup_lines": n_lines - np.bincount(line_of, minlength=n),
        "n_repeat_words": repeated_words(codes, offsets, WINDOW),
    }
    share = lambda a, b: np.asarray(a, float) / np.maximum(b, 1)
    counted = lambda pattern: pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False)
    top, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(top, of, count)
    np.maximum.at(longest, doc, sizes)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (doc[1:] == doc[:-1])
    wordless = ~pc.match_substring_regex(words, "\\pL").to_numpy(zero_copy_only=False).astype(bool)
    bits = np.bincount(of, weights=count * np.log(count), minlength=n)
    features = {
        "log_words": np.log1p(n_words),
        "mean_word": share(counts["word_chars"], n_words),
        "longest_word": np.log1p(longest),
        "symbols_per_word": share(counts["n_symbols"], n_words),
        "dup_line_share": share(counts["n_dup_lines"], n_lines),
        "repeat_share": share(counts["n_repeat_words"], n_words),
        "same_as_before": share(sums(same, offsets), n_words),
        "top_word_share": share(top, n_words),
        "distinct_share": share(np.bincount(of, minlength=n), n_words),
        "entropy": np.log(np.maximum(n_words, 1)) - share(bits, n_words),
        "wordless_share": share(sums(wordless, offsets), n_words),
        "digit_share": share(counted("[0-9]"), counts["word_chars"]),
        "upper_share": share(counted("\\p{Lu}"), counts["word_chars"]),
        "stop_share": share(sums(sizes <= 3, offsets), n_words),
        "words_per_line": np.log1p(share(n_words, n_lines)),
        "ended_lines": share(np.bincount(line_doc[full & ended], minlength=n), n_lines),
        "short_lines": share(np.bincount(line_doc[full & (line_words <= 3)], minlength=n), n_lines),
    }
    return counts | features


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``text`` replaced by its statistics; the other columns stay."""
    for batch in batches:
        texts = batch.column("text")
        lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        for start, end in slices(lengths, STEP_BYTES):
            part = batch.slice(start, end - start)
            found = statistics(part.column("text"))
            columns = {name: part.column(name) for name in batch.schema.names if name != "text"}
            columns |= {name: pa.array(found[name].astype(np.int64)) for name in COUNTS}
            columns["features"] = pa.FixedSizeListArray.from_arrays(pa.array(np.stack([found[f] for f in FEATURES], 1).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict(columns)


@dataclass
class Forest:
    """Trees as one array per field of a node; a leaf is its own child on both sides."""

    base: float
    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def raw(self, rows: np.ndarray) -> np.ndarray:
        """Log odds of every row: all rows walk all trees together."""
        at = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
        which = np.arange(len(rows))[:, None]
        for _ in range(self.depth):
            at = np.where(rows[which, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        parts = [self.raw(rows[i : i + 4096]) for i in range(0, len(rows), 4096)]
        return 1 / (1 + np.exp(-np.concatenate(parts))) if parts else np.zeros(0)


def boosted(rows: np.ndarray, good: np.ndarray, falling: list[int]) -> Forest:
    """Trees fitted to the rows' 0/1 labels; no feature in ``falling`` raises the score as it grows."""
    n, width = rows.shape
    cuts = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    bins = np.stack([np.searchsorted(cuts[f], rows[:, f], "left") for f in range(width)], 1)
    usable = np.arange(BINS)[None, :] < np.array([len(c) for c in cuts])[:, None]
    rate = np.clip(good.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(rate / (1 - rate)))
    raw = np.full(n, base)
    fields: dict[str, list] = {"feature": [], "threshold": [], "left": [], "right": [], "value": []}
    roots = []

    def node() -> int:
        i = len(fields["feature"])
        for name, x in (("feature", 0), ("threshold", np.inf), ("left", i), ("right", i), ("value", 0.0)):
            fields[name].append(x)
        return i

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        slope, curve = p - good, p * (1 - p)
        roots.append(node())
        open_nodes = [(roots[-1], np.arange(n), -np.inf, np.inf, 0)]
        while open_nodes:
            at, own, low, high, level = open_nodes.pop()
            g, h = slope[own].sum(), curve[own].sum()
            split = best_split(bins[own], slope[own], curve[own], usable, falling, low, high) if level < DEPTH else None
            if split is None:
                value = float(np.clip(-g / (h + RIDGE), low, high)) * RATE
                fields["value"][at] = value
                raw[own] += value
                continue
            f, b, left_value, right_value = split
            goes_left = bins[own, f] <= b
            fields["feature"][at], fields["threshold"][at] = f, cuts[f][b]
            fields["left"][at], fields["right"][at] = node(), node()
            middle = (left_value + right_value) / 2
            bounds = ((middle, high), (low, middle)) if f in falling else ((low, high), (low, high))
            open_nodes.append((fields["left"][at], own[goes_left], *bounds[0], level + 1))
            open_nodes.append((fields["right"][at], own[~goes_left], *bounds[1], level + 1))
    return Forest(base, np.array(roots), *(np.array(fields[k]) for k in ("feature", "threshold", "left", "right", "value")), DEPTH)


def best_split(bins: np.ndarray, slope: np.ndarray, curve: np.ndarray, usable: np.ndarray, falling: list[int], low: float, high: float):
    """``feature, bin, left value, right value`` of the split of greatest gain among the allowed ones, or None."""
    width = bins.shape[1]
    flat = (bins + np.arange(width) * BINS).ravel()
    totals = [np.bincount(flat, weights=None if w is None else np.repeat(w, width), minlength=width * BINS).reshape(width, BINS) for w in (slope, curve, None)]
    (g, h, n), (g_all, h_all, n_all) = (t.cumsum(axis=1) for t in totals), (slope.sum(), curve.sum(), len(slope))
    left = np.clip(-g / (h + RIDGE), low, high)
    right = np.clip(-(g_all - g) / (h_all - h + RIDGE), low, high)
    worth = lambda g, h, v: -(g * v + 0.5 * (h + RIDGE) * v * v)
    whole = np.clip(-g_all / (h_all + RIDGE), low, high)
    gain = worth(g, h, left) + worth(g_all - g, h_all - h, right) - worth(g_all, h_all, whole)
    allowed = usable & (n >= LEAST_ROWS) & (n_all - n >= LEAST_ROWS)
    allowed[falling] &= left[falling] >= right[falling]
    gain = np.where(allowed, gain, -np.inf)
    f, b = np.unravel_index(gain.argmax(), gain.shape)
    return (int(f), int(b), float(left[f, b]), float(right[f, b])) if gain[f, b] > 1e-6 else None


def measured(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, COUNTS and FEATURES (one array) of every document, written once."""
    rows = docs.select(*keep, F.col(text).alias("text"))
    shape = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text"] + [f"{c} long" for c in COUNTS])
    with short_batches(docs.sparkSession, ROWS):
        return settle(rows.mapInArrow(measure, f"{shape}, features array<double>"), "statistics")


def fitted(stats: DataFrame, labels: DataFrame, id: str, sample: int = SAMPLE) -> Forest | None:
    """Trees that tell the labelled documents of quality 1 from the others; None without labels of both classes."""
    of = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").alias(id)).agg((F.min("quality") == 1).alias("good"))
    known = settle(stats.select(id, "features").join(of, id).withColumn("order", order_key("quality", id)), "labelled")
    sizes = {r.good: r.n for r in known.groupBy("good").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    picked = []
    for good, n in sorted(sizes.items()):
        # Twice the share asked for travels, the exact number is cut from it.
        near = known.where((F.col("good") == good) & (key_fraction(F.col("order")) <= min(1.0, 2 * sample / n + 100 / n)))
        picked += [(r.features, good) for r in near.orderBy("order", "features").limit(sample).select("features").collect()]
    rows = np.array([f for f, _ in picked])
    return boosted(rows, np.array([g for _, g in picked], float), [FEATURES.index(f) for f in FALLING])


def scored(stats: DataFrame, forest: Forest | None, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``score``, the probability of quality 1 (1 without trees)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("features").flatten().to_numpy().reshape(-1, len(FEATURES))
            found = np.ones(len(rows)) if forest is None else forest.score(rows)
            yield pa.RecordBatch.from_pydict({name: batch.column(name) for name in keep} | {"score": pa.array(found)})

    kept = stats.select(*keep, "features")
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "features")
    return kept.mapInArrow(score, f"{shape}, score double")


def base_failed() -> Column:
    return (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words"))


def judged(docs: DataFrame, labels: DataFrame, id: str, train: Column) -> DataFrame:
    """Per document its id, COUNTS, ``base_failed``, ``kept`` and ``score``; trees learn from documents where ``train`` holds."""
    stats = measured(docs.withColumn("__train", train), [id, "__train"])
    forest = fitted(stats.where("__train"), labels, id)
    rows = scored(stats, forest, [id, *COUNTS]).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= 0.5)).select(id, *COUNTS, "base_failed", "kept", "score")
