"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is a learned vector of the word (zero for words outside the model's vocabulary), the mean of learned vectors of
its known character n-grams (3 to 5 bytes anywhere, longer ones at the start), and two numbers: the smoothed log-odds of the word,
and the largest of its n-grams', among toxic texts. While the network is trained, the log-odds of a text come from the other
training texts only, so that it learns how far to trust them. A text is cut into overlapping windows; two gated recurrent units read each window in both
directions, attention pools their states, and a linear layer gives the window's score. A text scores as its highest window,
calibrated on held-back training texts.

Training uses at most ``SAMPLE`` labelled texts of each class, those with the smallest hash of their id; the bound does not
depend on the input. Scoring reads every whole text. Null text counts as empty: one window without words, whose score is the
network's bias. Without labelled texts of both classes every score is 0. A text with several labels is toxic if any is.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, settle
from .common import give_back, slices, split_words, tidied

# Labelled texts of each class that training may use, and how they are used.
SAMPLE = 1500
SAMPLE_BYTES = 16_000_000
# Rounds of training and steps of each; after a round the windows that score highest are trained on.
ROUNDS, STEPS = 4, 48
# Parts of the training texts; each is read with the log-odds of the others.
FOLDS = 4
# Learned vectors move more slowly than the network, which reads the log-odds beside them.
VECTOR_RATE = 0.2
BATCH = 256
# Texts by which the log-odds of words and n-grams are drawn to the share of toxic texts.
PRIOR = 3.0
RATE = 0.01
# Words of a window, and the words from one window to the next.
WINDOW, STRIDE = 48, 32
# Words and n-grams kept, those in most training texts, and in how many one must be.
WORDS, GRAMS, SEEN = 30_000, 300_000, 3
# Sizes: vectors of words and of n-grams, recurrent units, attention units.
WORD_DIM, GRAM_DIM, UNITS, ATTENTION = 8, 4, 8, 8
GRAM_SIZES = (3, 4, 5)
START_SIZES = (6, 7, 8, 9, 10)
WIDTH = WORD_DIM + GRAM_DIM + 2
# Windows that are scored together, and words whose n-grams are made together.
SCORED = 1024
TOGETHER = 5_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def grams_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the character n-grams of distinct words, with a mark at either end, and longer ones at the start.

    Flat hashes and the words' offsets in them.
    """
    raw = pa.concat_arrays([words]).cast(pa.large_binary())
    sizes = pc.binary_length(raw).to_numpy().astype(np.int64) + 2
    ends = np.cumsum(sizes)
    flat = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    inner = np.ones(len(flat), bool)
    inner[ends - 1] = inner[ends - sizes] = False
    flat[inner] = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
    flat[ends - sizes], flat[ends - 1] = 2, 3
    left = np.repeat(ends, sizes) - np.arange(len(flat))  # bytes from here to the end of the word
    owner = np.repeat(np.arange(len(sizes)), sizes)
    hashes, owners = [], []
    for n in GRAM_SIZES + START_SIZES:
        here = np.flatnonzero(left >= n) if n in GRAM_SIZES else (ends - sizes)[sizes >= n]
        h = np.full(len(here), n, np.uint64)
        for k in range(n):
            h = (h ^ flat[here + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        hashes.append(h)
        owners.append(owner[here])
    gram, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return gram[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def gram_ends(words: pa.Array) -> np.ndarray:
    """The offsets of :func:`grams_of`, without the n-grams."""
    sizes = pc.binary_length(pa.concat_arrays([words]).cast(pa.large_binary())).to_numpy().astype(np.int64) + 2
    n = sum((np.maximum(0, sizes - n + 1) for n in GRAM_SIZES), np.zeros(len(sizes), np.int64))
    return np.concatenate([[0], np.cumsum(n + sum((sizes >= n).astype(np.int64) for n in START_SIZES))])


def windows_of(n_words: int) -> range:
    """Starts of the windows of a text; together they cover every word."""
    return range(0, max(1, n_words - WINDOW + STRIDE), STRIDE)


@dataclass
class Network:
    words: list[str]
    p: dict[str, np.ndarray]
    word_odds: np.ndarray
    # Hashes of the known n-grams, sorted; their odds, and after them those of all others.
    grams: np.ndarray
    gram_odds: np.ndarray
    scale: float = 1.0
    shift: float = 0.0
    rounds: int = 0

    def inputs(self, distinct: pa.Array) -> np.ndarray:
        """Input vectors of distinct words; the row after the last is the padding."""
        x = np.zeros((len(distinct) + 1, WIDTH), np.float32)
        if len(distinct):
            at = pc.index_in(distinct, value_set=pa.array(self.words, distinct.type)).to_numpy(zero_copy_only=False)
            known = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
            for a in range(0, len(distinct), TOGETHER):
                b = min(a + TOGETHER, len(distinct))
                rows = np.where(known[a:b], at[a:b], -1).astype(np.int64)
                gram, ends = grams_of(distinct.slice(a, b - a))
                x[a:b] = self.vectors(rows, self.places(gram), ends)
        return x

    def places(self, gram: np.ndarray) -> np.ndarray:
        """Places of n-grams among the known ones; the place after the last for the others."""
        at = np.searchsorted(self.grams, gram)
        at[at == len(self.grams)] = 0
        return np.where(self.grams[at] == gram, at, len(self.grams)) if len(self.grams) else np.zeros(len(gram), np.int64)

    def vectors(self, rows: np.ndarray, bucket: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Input vectors of words, given by their rows in the vocabulary (-1: none) and their n-grams."""
        x = np.zeros((len(rows), WIDTH), np.float32)
        if len(rows):
            known = rows >= 0
            x[known, :WORD_DIM] = self.p["word"][rows[known]]
            x[:, WORD_DIM:-2] = np.add.reduceat(self.p["gram"][bucket], ends[:-1]) / np.diff(ends)[:, None]
            x[:, -2] = np.maximum.reduceat(self.gram_odds[bucket], ends[:-1])
            x[known, -1] = self.word_odds[rows[known]]
        return x

    def forward(self, x: np.ndarray, codes: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Scores of windows given as codes (windows by words) into the input vectors."""
        p, (rows, steps) = self.p, codes.shape
        states, tape = [], {}
        for d in ("f", "b"):
            order = range(steps) if d == "f" else range(steps - 1, -1, -1)
            read = x @ p["W" + d] + p["c" + d]
            h = np.zeros((rows, UNITS), np.float32)
            hs = np.zeros((steps, rows, UNITS), np.float32)
            kept = []
            for t in order:
                a = read[codes[:, t]]
                zr = _sigmoid(a[:, : 2 * UNITS] + h @ p["U" + d])
                z, r = zr[:, :UNITS], zr[:, UNITS:]
                n = np.tanh(a[:, 2 * UNITS :] + (r * h) @ p["V" + d])
                m = mask[:, t, None]
                new = h + m * z * (n - h)
                if keep:
                    kept.append((t, h, z, r, n, m))
                h = hs[t] = new
            states.append(hs)
            tape[d] = kept
        H = np.concatenate(states, 2)  # steps, windows, both directions
        A = np.tanh(H @ p["Wa"] + p["ca"])
        e = A @ p["va"] + np.where(mask.T > 0, 0, -1e4).astype(np.float32)
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = (w[:, :, None] * H).sum(0)
        out = pooled @ p["wo"] + p["co"][0]
        return (out, tape, H, A, w, pooled) if keep else out

    def backward(self, x, codes, mask, target) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """Mean loss of windows, and the gradients of the weights and of the input vectors."""
        p, (rows, steps) = self.p, codes.shape
        out, tape, H, A, w, pooled = self.forward(x, codes, mask, keep=True)
        prob = _sigmoid(out)
        loss = -np.mean(np.log(np.where(target > 0, prob, 1 - prob) + 1e-9))
        g = {k: np.zeros_like(v) for k, v in p.items() if k not in ("word", "gram")}
        do = ((prob - target) / rows).astype(np.float32)
        g["wo"], g["co"] = pooled.T @ do, np.array([do.sum()], np.float32)
        dpool = do[:, None] * p["wo"]
        dw = (H * dpool).sum(2)
        de = w * (dw - (w * dw).sum(0))
        dA = de[:, :, None] * p["va"] * (1 - A * A)
        g["va"] = (A * de[:, :, None]).sum((0, 1))
        g["Wa"], g["ca"] = np.einsum("tbi,tbj->ij", H, dA), dA.sum((0, 1))
        dH = w[:, :, None] * dpool + dA @ p["Wa"].T
        dx = np.zeros_like(x)
        for i, d in enumerate(("f", "b")):
            carry = np.zeros((rows, UNITS), np.float32)
            dread = np.zeros((len(x), 3 * UNITS), np.float32)
            for t, h, z, r, n, m in reversed(tape[d]):
                dh = carry + dH[t, :, i * UNITS : (i + 1) * UNITS]
                dn = dh * m * z * (1 - n * n)
                dz = dh * m * (n - h) * z * (1 - z)
                drh = dn @ p["V" + d].T
                dr = drh * h * r * (1 - r)
                dzr = np.concatenate([dz, dr], 1)
                g["V" + d] += (r * h).T @ dn
                g["U" + d] += h.T @ dzr
                carry = dh * (1 - m * z) + drh * r + dzr @ p["U" + d].T
                np.add.at(dread, codes[:, t], np.concatenate([dzr, dn], 1))
            g["W" + d], g["c" + d] = x.T @ dread, dread.sum(0)
            dx += dread @ p["W" + d].T
        return float(loss), g, dx

    def windows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every window of the texts: its text, the place of its first word among all words, and its score."""
        offsets, flat = split_words(texts)
        coded = flat.dictionary_encode()
        x = self.inputs(coded.dictionary)
        codes = np.append(coded.indices.to_numpy(), np.full(WINDOW, len(coded.dictionary), np.int32))
        starts = [s + np.arange(0, max(1, e - s - WINDOW + STRIDE), STRIDE) for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
        at = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        scores = np.zeros(len(at))
        for a in range(0, len(at), SCORED):
            where = at[a : a + SCORED, None] + np.arange(WINDOW)
            inside = where < offsets[1:][owner[a : a + SCORED], None]
            some = np.where(inside, codes[np.minimum(where, len(codes) - 1)], len(x) - 1)
            scores[a : a + SCORED] = self.forward(x, some, inside.astype(np.float32))
        return owner, at, scores

    def score(self, texts: pa.Array) -> np.ndarray:
        """Highest window of every text, before calibration."""
        best = np.full(len(texts), -np.inf)
        owner, _, scores = self.windows(texts)
        np.maximum.at(best, owner, scores)
        return best

    def probability(self, texts: pa.Array) -> np.ndarray:
        return _sigmoid(self.scale * self.score(texts) + self.shift)


def _counts(held: Iterable[tuple[int, np.ndarray]], n_items: int, label: np.ndarray) -> np.ndarray:
    """Texts that hold each item, and toxic texts among them."""
    out = np.zeros((2, n_items), np.float32)
    for text, items in held:
        out[0, items] += 1
        out[1, items] += label[text] > 0
    return out


def _odds(counts: np.ndarray, share: float) -> np.ndarray:
    """Smoothed log-odds of items against the share of toxic texts."""
    all_, bad = counts
    odds = np.log((bad + PRIOR * share) / (all_ - bad + PRIOR * (1 - share))) - np.log(share / (1 - share))
    return odds.astype(np.float32)


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """Fit the network; one text in five is held back for the calibration. None without both classes."""
    label = np.array(labels, np.float32)
    if not (label > 0).any() or not (label <= 0).any():
        return None
    rng = np.random.default_rng(seed)
    offsets, flat = split_words(pa.array(texts, pa.string()))
    coded = flat.dictionary_encode()
    distinct, pad = coded.dictionary, len(coded.dictionary)
    padded = np.append(coded.indices.to_numpy(), np.full(WINDOW, pad, np.int32))
    codes = padded[:-WINDOW]
    del flat, coded
    give_back(cycles=False)
    held = np.arange(len(texts)) % 5 == 4
    fit = np.flatnonzero(~held)
    if not (label[fit] > 0).any() or not (label[fit] <= 0).any():
        fit = np.arange(len(texts))
    share = float((label[fit] > 0).mean())
    fold_of = {i: k % FOLDS for k, i in enumerate(fit.tolist())}
    mine = [(i, np.unique(codes[offsets[i] : offsets[i + 1]])) for i in fit.tolist()]
    # The driver's memory is small: n-grams are made some words at a time, and again for their places, never beside a copy.
    ends = gram_ends(distinct)
    every = np.empty(int(ends[-1]), np.uint64)
    for a in range(0, pad, TOGETHER):
        b = min(a + TOGETHER, pad)
        every[ends[a] : ends[b]] = grams_of(distinct.slice(a, b - a))[0]
    every.sort()
    every = every[np.concatenate([np.ones(min(1, len(every)), bool), every[1:] != every[:-1]])]
    bucket = np.empty(int(ends[-1]), np.int32)
    for a in range(0, pad, TOGETHER):
        b = min(a + TOGETHER, pad)
        bucket[ends[a] : ends[b]] = np.searchsorted(every, grams_of(distinct.slice(a, b - a))[0])
    give_back(cycles=False)

    def grams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = np.diff(ends)[words]
        after = np.concatenate([[0], np.cumsum(n)])
        return bucket[np.arange(after[-1]) + np.repeat(ends[:-1][words] - after[:-1], n)], after

    def most_seen(held_items: Iterable[tuple[int, np.ndarray]], n_items: int, most: int) -> np.ndarray:
        seen = np.zeros(n_items, np.int32)
        for _, items in held_items:
            seen[items] += 1
        some = np.flatnonzero(seen >= SEEN)
        return some[np.argsort(-seen[some], kind="stable")[:most]]

    # n-grams of a text are those of its distinct words.
    kept = most_seen(mine, pad, WORDS)
    known = np.sort(most_seen(((i, np.unique(grams(words)[0])) for i, words in mine), len(every), GRAMS))
    place = np.full(len(every), len(known), np.int32)
    place[known] = np.arange(len(known))
    known_grams = every[known]
    del every
    for a in range(0, len(bucket), 500_000):
        bucket[a : a + 500_000] = place[bucket[a : a + 500_000]]
    del place
    row_of_word = np.full(pad + 1, -1)
    row_of_word[kept] = np.arange(len(kept))

    # Counts by fold; a fold's texts are read with the odds of the other folds, new texts with those of all.
    word_counts, gram_counts = [], []
    for k in range(FOLDS):
        part = [(i, words) for i, words in mine if fold_of[i] == k]
        rows = ((i, row_of_word[words][row_of_word[words] >= 0]) for i, words in part)
        word_counts.append(_counts(rows, len(kept), label))
        gram_counts.append(_counts(((i, np.unique(grams(words)[0])) for i, words in part), len(known) + 1, label)[:, :-1])
    word_all, gram_all = sum(word_counts), sum(gram_counts)

    def odds_without(k: int | None) -> tuple[np.ndarray, np.ndarray]:
        words, grams_ = (word_all, gram_all) if k is None else (word_all - word_counts[k], gram_all - gram_counts[k])
        return _odds(words, share), np.append(_odds(grams_, share), np.float32(0))

    odds, odds_of_all = [odds_without(k) for k in range(FOLDS)], odds_without(None)

    def small(*shape):
        return (rng.standard_normal(shape) * 0.1).astype(np.float32)

    p = {"word": small(len(kept), WORD_DIM), "gram": np.vstack([small(len(known), GRAM_DIM), np.zeros((1, GRAM_DIM), np.float32)])}
    for d in ("f", "b"):
        p |= {"W" + d: small(WIDTH, 3 * UNITS) * 3, "c" + d: np.zeros(3 * UNITS, np.float32), "U" + d: small(UNITS, 2 * UNITS), "V" + d: small(UNITS, UNITS)}
    p |= {"Wa": small(2 * UNITS, ATTENTION) * 3, "ca": np.zeros(ATTENTION, np.float32), "va": small(ATTENTION) * 3, "wo": small(2 * UNITS) * 3, "co": np.zeros(1, np.float32)}
    names = [str(w) for w in distinct.take(pa.array(kept)).to_pylist()]
    net = Network(names, p, *odds[0][:1], known_grams, odds[0][1])
    del mine, word_counts, gram_counts
    give_back(cycles=False)

    def window_scores(k: int) -> dict[int, np.ndarray]:
        """Scores of all windows of a fold's texts; at first, without a trained network, their strongest log-odds."""
        some = [i for i in fit.tolist() if fold_of[i] == k]
        if net.rounds == 0:
            word, gram = odds[k]
            strength = np.append(word, np.float32(-9))[row_of_word[:-1]]
            if pad:
                strength = np.maximum(strength, np.maximum.reduceat(gram[bucket], ends[:-1]))
            spans = {i: [(s, min(s + WINDOW, offsets[i + 1])) for s in offsets[i] + np.array(windows_of(int(offsets[i + 1] - offsets[i])))] for i in some}
            return {i: np.array([strength[codes[a:b]].max(initial=-9) for a, b in spans[i]]) for i in some}
        net.word_odds, net.gram_odds = odds[k]
        owner, _, scores = net.windows(pa.array([texts[i] for i in some], pa.string()))
        give_back(cycles=False)
        return {i: scores[owner == j] for j, i in enumerate(some)}

    def chosen(k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Windows of a fold by class: the highest of a toxic text; of a clean one the two highest and another."""
        out: list[list[tuple[int, int]]] = [[], []]
        for i, scores in window_scores(k).items():
            best = np.argsort(-scores, kind="stable")
            picks = best[:1] if label[i] > 0 else [*best[:2], rng.integers(len(best))]
            out[int(label[i] > 0)] += [(offsets[i] + STRIDE * int(w), i) for w in picks]
        return [np.array(x, np.int64).reshape(-1, 2) for x in out]

    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in p.items()}
    # Every step takes windows of one fold, as many of either class, each class in shuffled turns.
    half = BATCH // 2
    for step in range(1, ROUNDS * STEPS + 1):
        turn, k = divmod((step - 1) % STEPS, FOLDS)
        if (step - 1) % STEPS == 0:
            folds = [chosen(j) for j in range(FOLDS)]
            give_back(cycles=False)
            net.rounds += 1
            turns = [[rng.permutation(np.resize(rng.permutation(len(c)), -(-STEPS // FOLDS) * half)) if len(c) else None for c in f] for f in folds]
        pick = np.concatenate([c[t[turn * half : (turn + 1) * half]] for c, t in zip(folds[k], turns[k], strict=True) if t is not None])
        net.word_odds, net.gram_odds = odds[k]
        starts, of = pick[:, 0], pick[:, 1]
        at = starts[:, None] + np.arange(WINDOW)
        inside = at < offsets[1:][of, None]
        some = np.where(inside, padded[np.minimum(at, len(padded) - 1)], pad)
        used, local = np.unique(some, return_inverse=True)
        real = used[used != pad]
        rows, (flat_grams, after) = row_of_word[real], grams(real)
        x = np.zeros((len(used), WIDTH), np.float32)
        x[: len(real)] = net.vectors(rows, flat_grams, after)
        _, g, dx = net.backward(x, local.reshape(some.shape), inside.astype(np.float32), label[of])
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], rows[rows >= 0], dx[: len(real)][rows >= 0, :WORD_DIM])
        n = np.diff(after)
        np.add.at(g["gram"], flat_grams, np.repeat(dx[: len(real), WORD_DIM:-2] / np.maximum(1, n)[:, None], n, 0))
        g["gram"][-1] = 0
        rate = RATE * min(1.0, 2 * (1 - step / (ROUNDS * STEPS + 1)))
        for k, v in p.items():
            m, s = moments[k]
            m += 0.1 * (g[k] - m)
            s += 0.001 * (g[k] * g[k] - s)
            v -= rate * (VECTOR_RATE if k in ("word", "gram") else 1.0) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-6)
    net.word_odds, net.gram_odds = odds_of_all
    raw = net.score(pa.array([t for t, h in zip(texts, held, strict=True) if h], pa.string())) if held.any() else np.zeros(0)
    net.scale, net.shift = _calibrated(raw, label[held])
    return net


def _calibrated(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic curve through the held-back texts."""
    if not (label > 0).any() or not (label <= 0).any():
        return 1.0, 0.0
    centre, spread = raw.mean(), raw.std() + 1e-6
    x, a, b = (raw - centre) / spread, 1.0, 0.0
    for _ in range(500):
        error = _sigmoid(a * x + b) - label
        a -= 0.5 * ((error * x).mean() + 0.002 * a)
        b -= 0.5 * error.mean()
    return float(a / spread), float(b - a * centre / spread)


def sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> tuple[list[str], list[int]]:
    """At most ``most`` labelled texts and ``most_bytes`` of each class, by the hash of the id; training needs a bounded set.

    Labels meet the documents' ids before anything is cut, so labels of other documents take no place. A text that would
    pass the bytes is left out for the next smaller one.
    """
    marked = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("__t"))
    met = settle(sizes.join(marked, "doc_id").withColumn("__h", F.xxhash64(F.lit("toxicity"), "doc_id")), "labelled")
    texts, classes = [], []
    for toxic in (1, 0):
        of = met.where((F.col("toxic") > 0) == bool(toxic)).orderBy("__h", "doc_id", "__t").limit(most).select("doc_id", "__t", "size").collect()
        room, chosen = most_bytes, []
        for r in of:
            if r["size"] <= room:
                room -= r["size"]
                chosen.append((r["doc_id"], r["__t"], len(chosen)))
        if not chosen:
            continue
        # Repeated rows are one each.
        named = docs.sparkSession.createDataFrame(chosen, met.select("doc_id", "__t").schema.add("__at", "integer")).dropDuplicates(["doc_id", "__t"])
        found = docs.select("doc_id", "text", F.xxhash64("text").alias("__t")).join(F.broadcast(named), ["doc_id", "__t"])
        found = found.groupBy("__at").agg(F.first("text", ignorenulls=True).alias("text")).collect()
        texts += [r["text"] or "" for r in sorted(found, key=lambda r: r["__at"])]
        classes += [toxic] * len(found)
    # What led to the texts goes, from the driver's memory too, before the network is trained there.
    discard(met)
    # Interleave the classes, so that every fifth text is a fair sample.
    order = sorted(range(len(texts)), key=lambda i: (i if i < classes.count(1) else i - classes.count(1), classes[i]))
    return [texts[i] for i in order], [classes[i] for i in order]


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Network | None:
    net = train(*sample(docs, labels, most))
    give_back()
    return net


def scored(spark: SparkSession, rows: DataFrame, net: Network | None, keep: list[str], out: str = "score") -> DataFrame:
    """``keep`` columns of the rows, and the score of their whole texts under the name ``out``."""
    if net is None:
        return rows.select(*keep, F.lit(0.0).alias(out))
    sent = spark.sparkContext.broadcast(net)
    given = rows.select(*keep) if "text" in keep else rows.select(*keep, F.col("text").alias("__text"))
    at = keep.index("text") if "text" in keep else len(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = batch.column(at)
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(sizes, 4_000_000):
                part = batch.slice(a, b - a)
                columns = [*part.columns[: len(keep)], pa.array(model.probability(texts.slice(a, b - a)).astype(np.float64))]
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, out])

    return given.mapInArrow(tidied(work), rows.select(*keep).schema.add(out, "double"))
