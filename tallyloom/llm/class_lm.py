"""Language-model scoring with a Brown class-based bigram model.

``log P(text)`` sums, over its words and one end, ``P(class | class before) * P(word | class)``; the end stands before the
first word too. Every training word has a class of its own. First, exchange clustering assigns units: the most frequent
words, each alone, and all other words by a hashed ending. Each round counts the classes beside every unit and moves units to
the class that raises the likelihood of the class bigrams most, a third of them at a time, until no third raises it; a round
that lowers it is taken back. Then the frequent words stand, and every other training word goes to the class that raises the
likelihood most, by the classes beside it in all training text, in rounds until the likelihood rises by less than
``SETTLED`` of itself. Endings stay for words that training has not seen: those share the class of their ending.

The texts are cut into words once and written as chunks: the distinct words of a chunk, packed, and codes into them. Word counts cover
the whole training vocabulary and are joined with the chunks' distinct words, not with every occurrence; nothing that grows
with the corpus is broadcast or collected. Classes of words travel as their counts do. What is sent to the driver is bounded
by the model: ``WORDS + ENDINGS + 1`` units times ``CLASSES``.

Null text counts as empty: one token, the end. Repeated rows are scored each and count in training each. A missing id counts
as the empty text when it is dealt to training.
"""

from __future__ import annotations

import secrets
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, settle
from .common import give_back, joined, short_batches, slices, split_words, tidied

# Units: the end, frequent words, hashed endings of this many bytes.
WORDS, ENDINGS, ENDING_BYTES = 2048, 2048, 3
UNITS = 1 + WORDS + ENDINGS
CLASSES = 48
# Rounds end when the likelihood rises by less than this share of itself.
SETTLED = 1e-4
# Units are moved in turns, so that neighbours do not move at once.
TURNS = 3
# Added to every count of a word or unit; weight of the class shares in class transitions.
ADDED = 0.5
TRANSITION_PRIOR = 20.0
CHUNK_BYTES = 8_000_000
# The end of a text, among words; no word is empty.
END = ""


def chunks(documents: DataFrame, train: str) -> DataFrame:
    """Texts as coded chunks, written once. A chunk's number is random; the written table keeps it.

    ``documents`` has ``doc_id``, ``text`` and the boolean column ``train``.
    """
    kind = dict(documents.dtypes)["doc_id"]
    schema = f"chunk bigint, ids array<{kind}>, train array<boolean>, sizes array<int>, codes binary, words binary, n_words int"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2)
            lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            for a, b in slices(lengths, CHUNK_BYTES):
                offsets, flat = split_words(texts.slice(a, b - a))
                coded = flat.dictionary_encode()
                one = [
                    pa.array([secrets.randbits(63)]),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(0).slice(a, b - a)),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column(1).slice(a, b - a)),
                    pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), pa.array(np.diff(offsets).astype(np.int32))),
                    pa.array([pa.compress(coded.indices.to_numpy().astype("<i4").tobytes(), "zstd", asbytes=True)], pa.binary()),
                    pa.array([_packed(coded.dictionary.cast(pa.string()))], pa.binary()),
                    pa.array([len(coded.dictionary)], pa.int32()),
                ]
                yield pa.RecordBatch.from_arrays(one, names=["chunk", "ids", "train", "sizes", "codes", "words", "n_words"])

    with short_batches(documents.sparkSession, 2000):
        return settle(documents.select("doc_id", F.col(train).alias("train"), "text").mapInArrow(tidied(work), schema), "chunks")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of a batch of chunks: the row, codes of its words, sizes of its texts, and which are for training."""
    for i in range(batch.num_rows):
        row = {name: batch.column(k)[i] for k, name in enumerate(batch.schema.names)}
        sizes = row["sizes"].values.to_numpy(zero_copy_only=False).astype(np.int64)
        row["words"] = _unpacked(row["words"].as_py())[0]
        codes = np.frombuffer(pa.decompress(row["codes"].as_py(), 4 * int(sizes.sum()), "zstd", asbytes=True), "<i4")
        yield row, codes, sizes, row["train"].values.to_numpy(zero_copy_only=False).astype(bool)


def word_counts(table: DataFrame) -> DataFrame:
    """``word, n``: every word of the training texts and the end, written. Words travel packed by part, not as a row each."""
    parts = parts_of(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, codes, sizes, train in _rows(batch):
                words = row["words"]
                n = np.bincount(codes[np.repeat(train, sizes)], minlength=len(words))
                seen = np.flatnonzero(n)
                met, n = pa.concat_arrays([words.take(pa.array(seen)), pa.array([END])]), np.append(n[seen], train.sum())
                part, order = dealt(met, parts)
                yield from _by_part(np.searchsorted(part, np.arange(parts + 1)), [met.take(pa.array(order)), pa.array(n[order])])

    def added(rows: pa.Table) -> pa.Table:
        given = [_unpacked(x.as_py()) for x in rows["data"]]
        coded = pa.chunked_array([x[0] for x in given]).combine_chunks().dictionary_encode()
        # Sums of whole numbers, exact below 2 ** 53.
        n = np.bincount(coded.indices.to_numpy(), weights=np.concatenate([x[1].to_numpy() for x in given])).astype(np.int64)
        out = pa.table({"word": coded.dictionary, "n": pa.array(n)}).filter(pa.array(n > 0))
        del given, coded
        give_back(cycles=False)
        return out

    with short_batches(table.sparkSession, 1):
        partial = settle(table.mapInArrow(tidied(work), "part int, data binary"), "counted")
    counts = settle(partial.groupBy("part").applyInArrow(added, "word string, n bigint"), "counts")
    discard(partial)
    return counts


def units_of(words: pa.Array, frequent: pa.Array) -> np.ndarray:
    """The unit of distinct words."""
    if not len(words):
        return np.zeros(0, np.int64)
    alone = pc.fill_null(pc.index_in(words, value_set=frequent), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = pa.concat_arrays([words]).cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.append(np.frombuffer(raw.buffers()[2] or b"", np.uint8), np.uint8(0))
    at = ends[1:, None] + np.arange(-ENDING_BYTES, 0)
    flat = np.where(at >= ends[:-1, None], data[at], 0)
    h = np.zeros(len(words), np.uint64)
    for k in range(ENDING_BYTES):
        h = (h ^ flat[:, k]) * np.uint64(0x100000001B3) + np.uint64(0x9E3779B9)
        h ^= h >> np.uint64(15)
    rare = 1 + WORDS + ((h >> np.uint64(7)) % np.uint64(ENDINGS)).astype(np.int64)
    return np.where(alone >= 0, 1 + alone, rare)


def _sequence(units: np.ndarray, codes: np.ndarray, sizes: np.ndarray, end: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Units of the texts one after the other, an end before the first and after each, and the places of those ends."""
    ends = np.cumsum(sizes + 1)
    out = np.full(int(ends[-1]) + 1 if len(ends) else 1, end, units.dtype)
    place = np.ones(len(out), bool)
    place[0] = False
    place[ends] = False
    out[place] = units[codes] if len(codes) else end
    return out, ends


def unit_bigrams(table: DataFrame, frequent: pa.Array) -> DataFrame:
    """``a, b, n``: units that follow one another in the training texts, written; at most ``UNITS ** 2`` rows."""
    sent = table.sparkSession.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # All pairs of units of a task: their number is bounded by the model.
        counts = np.zeros(UNITS * UNITS, np.int32)
        for batch in batches:
            for row, codes, sizes, train in _rows(batch):
                units = units_of(row["words"], sent.value)
                seq, _ = _sequence(units, codes[np.repeat(train, sizes)], sizes[train])
                pair, n = np.unique(seq[:-1] * UNITS + seq[1:], return_counts=True)
                counts[pair] += n
        seen = np.flatnonzero(counts)
        for a in range(0, len(seen), 1_000_000):
            some = seen[a : a + 1_000_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some])], names=["pair", "n"])

    partial = table.mapInArrow(tidied(work), "pair int, n int")
    sums = partial.groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = sums.select(F.floor(F.col("pair") / UNITS).cast("int").alias("a"), (F.col("pair") % UNITS).alias("b"), "n")
    with short_batches(table.sparkSession, 1):
        return settle(pairs, "bigrams")


def _own(bigrams: DataFrame) -> np.ndarray:
    """How often each unit follows itself."""
    own = np.zeros(UNITS)
    same = bigrams.where("a = b").select("a", "n").toArrow()
    own[same["a"].to_numpy()] = same["n"].to_numpy()
    return own


# Bigrams of units that are written as one value.
PACKED = 500_000


def packed_bigrams(bigrams: DataFrame) -> DataFrame:
    """``data``: bigrams of units seen from both units (a unit's number, ``UNITS`` more on its right, the other unit, n), written."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy().astype("<i8") for c in batch.columns]))
            if sum(x.shape[1] for x in held) >= PACKED:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["data"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held, axis=1).tobytes()], pa.binary())], names=["data"])

    left = bigrams.select(F.col("b").cast("int").alias("unit"), F.col("a").cast("int").alias("other"), "n")
    right = bigrams.select((F.col("a") + UNITS).cast("int").alias("unit"), F.col("b").cast("int").alias("other"), "n")
    # A unit's side stays in one task, so that what a task sums is not sent twice.
    return settle(left.unionAll(right).repartition("unit").mapInArrow(tidied(work), "data binary"), "packed")


def _beside(packed: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per unit, how often a unit of each class precedes it and follows it."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(2 * UNITS * CLASSES)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                unit, other, n = np.frombuffer(x, "<i8").reshape(3, -1)
                sums += np.bincount(unit * CLASSES + classes[other], weights=n, minlength=len(sums))
        seen = np.flatnonzero(sums)
        cells = np.stack([seen, sums[seen].astype(np.int64)]).astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.array([cells.tobytes()], pa.binary())], names=["data"])

    with short_batches(packed.sparkSession, 1):
        got = packed.mapInArrow(tidied(work), "data binary").toArrow()
    m = np.zeros(2 * UNITS * CLASSES)
    for x in got["data"]:
        cell, n = np.frombuffer(x.as_py(), "<i8").reshape(2, -1)
        m[cell] += n
    left, right = m.reshape(2, UNITS, CLASSES)
    return left, right


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-12))


def _table(right: np.ndarray, classes: np.ndarray) -> np.ndarray:
    m = np.zeros((CLASSES, CLASSES))
    np.add.at(m, classes, right)
    return m


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to what no move changes."""
    return float(_f(m).sum() - _f(m.sum(0)).sum() - _f(m.sum(1)).sum())


def exchanged(left: np.ndarray, right: np.ndarray, own: np.ndarray, classes: np.ndarray, movers: np.ndarray) -> np.ndarray:
    """Classes after each of the movers, in turn, went where the likelihood rises most."""
    classes, m = classes.copy(), _table(right, classes)
    for u in movers:
        a, r, l, s = classes[u], right[u].copy(), left[u].copy(), own[u]
        r[a] -= s
        l[a] -= s
        base = m.copy()
        base[a] -= r
        base[:, a] -= l
        base[a, a] -= s
        base = np.maximum(base, 0)
        old, diag = _f(base), np.arange(CLASSES)
        rows, cols = _f(base + r) - old, _f(base + l[:, None]) - old
        both = _f(base[diag, diag] + r + l + s) - old[diag, diag]
        gain = rows.sum(1) - rows[diag, diag] + cols.sum(0) - cols[diag, diag] + both
        out, into = base.sum(1), base.sum(0)
        gain -= _f(out + r.sum() + s) - _f(out) + _f(into + l.sum() + s) - _f(into)
        b = int(np.argmax(gain))
        base[b] += r
        base[:, b] += l
        base[b, b] += s
        m, classes[u] = base, b
    return classes


@dataclass
class ClassModel:
    """The bounded part of the model; counts and classes of single words are joined, not held."""

    frequent: pa.Array
    classes: np.ndarray
    log_transition: np.ndarray
    log_unit: np.ndarray
    # Per class, what a word's or an unseen ending's count is divided by.
    log_size: np.ndarray
    train_tokens: int
    vocabulary: int
    end_count: int
    # Likelihoods of the rounds of units, and of the rounds of words after them.
    rounds: list[float]
    word_rounds: list[float]
    # Occurrences of the frequent words, and the parts that words are dealt to.
    alone: np.ndarray
    parts: int
    # ``part, data``: the training words that are not frequent, packed, and the place of the class each has.
    packed: DataFrame | None = None
    place: int = 2

    @property
    def words(self) -> DataFrame:
        """``word, n, class`` of the training words that are not frequent."""
        return _worded(self.packed, self.place)


def _unit_classes(bigrams: DataFrame, total: np.ndarray) -> tuple[np.ndarray, list[float]]:
    """Exchange of units until no third of them raises the likelihood."""
    own = _own(bigrams)
    # Frequent units are dealt to the classes in turn.
    classes = np.zeros(UNITS, np.int64)
    order = np.argsort(-total, kind="stable")
    classes[order] = np.arange(UNITS) % CLASSES
    packed = packed_bigrams(bigrams)
    left, right = _beside(packed, classes)
    best = likelihood(_table(right, classes))
    rounds, still, k = [best], 0, 0
    while still < TURNS:
        movers = [int(u) for u in order if u % TURNS == k % TURNS and total[u] > 0]
        after = exchanged(left, right, own, classes, np.array(movers, np.int64))
        beside = _beside(packed, after)
        value = likelihood(_table(beside[1], after))
        rounds.append(value)
        still = still + 1 if value - best <= SETTLED * abs(best) else 0
        if value > best:
            best, classes, (left, right) = value, after, beside
        k += 1
    discard(packed)
    return classes, rounds


# Pairs of a side and a class; a word's contexts are packed as such pairs and counts, both of one byte.
SIDES = 2 * CLASSES
MOST = 255
# Words are dealt to parts by their hash: rows of words that a part has about, and the least number of parts.
PART_ROWS, PARTS = 1_500_000, 48


def _packed(*columns: pa.Array) -> bytes:
    """Columns as one compressed value."""
    batch = pa.RecordBatch.from_arrays(list(columns), names=[str(i) for i in range(len(columns))])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(value: bytes) -> list[pa.Array]:
    batch = pa.ipc.open_stream(value).read_next_batch()
    return batch.columns


def parts_of(table: DataFrame) -> int:
    """Parts that words are dealt to."""
    return max(PARTS, (table.agg(F.sum("n_words")).first()[0] or 0) // PART_ROWS)


# Bytes of a word that are hashed for all words together; longer words are hashed one by one.
HASHED = 64


def _hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, of all their bytes."""
    data, at = joined(words)
    starts, sizes = at[:-1], np.diff(at)
    # Eight bytes from every place on.
    eight = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    h = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    some = np.flatnonzero(sizes <= HASHED)
    for k in range(0, HASHED, 8):
        some = some[sizes[some] > k]
        if not len(some):
            break
        spare = np.maximum(0, 8 * (k + 8 - sizes[some])).astype(np.uint64)
        x = (h[some] ^ (eight[starts[some] + k] << spare)) * np.uint64(0xD6E8FEB86659FD93)
        h[some] = x ^ (x >> np.uint64(32))
    for i in np.flatnonzero(sizes > HASHED).tolist():
        h[i] = zlib.crc32(data[at[i] : at[i + 1]]) * 0x9E3779B97F4A7C15 % 2**64
    return h

def dealt(words: pa.Array, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of words, ascending, and the places of the words in that order."""
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    part = ((_hashes(words) >> np.uint64(16)) % np.uint64(parts)).astype(np.uint16 if parts < 2**16 else np.int64)
    order = np.argsort(part, kind="stable")
    return part[order], order


def _by_part(bounds: np.ndarray, columns: list[pa.Array], *more: pa.Array, names: tuple = ("part", "data")) -> Iterator[pa.RecordBatch]:
    """A row for each part: its number, ``more``, and the columns between its two bounds as one value."""
    for part in np.flatnonzero(np.diff(bounds)).tolist():
        # A slice would be written with all bytes of its column.
        some = [pa.concat_arrays([x.slice(bounds[part], bounds[part + 1] - bounds[part])]) for x in columns]
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *more, pa.array([_packed(*some)])], names=list(names))


def sequences(table: DataFrame, frequent: pa.Array, classes: np.ndarray, parts: int | None = None) -> DataFrame:
    """``chunk, seq, words, bounds, classes``: per chunk, its training texts for the rounds of words, written.

    ``words`` are the chunk's training words that are not frequent, by part; a part's are those between two ``bounds``. ``seq``
    has the class of an end or frequent word, which stands, and ``CLASSES`` more than the number of any other word.
    ``classes`` are those that the other words start with.
    """
    sent = table.sparkSession.sparkContext.broadcast((frequent, classes))
    parts = parts or parts_of(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, classes = sent.value
        for batch in batches:
            for row, codes, sizes, train in _rows(batch):
                words = row["words"]
                units = units_of(words, frequent)
                codes, sizes = codes[np.repeat(train, sizes)], sizes[train]
                met = np.zeros(len(words), bool)
                met[codes] = True
                rare = np.flatnonzero(met & (units > WORDS))
                part, order = dealt(words.take(pa.array(rare)), parts)
                rare = rare[order]
                number = classes[units]
                number[rare] = CLASSES + np.arange(len(rare))
                seq, _ = _sequence(number, codes, sizes, int(classes[0]))
                bounds = np.searchsorted(part, np.arange(parts + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["chunk"].as_py()]), pa.array([_packed(pa.array(seq.astype(np.int32)))]), pa.array([_packed(words.take(pa.array(rare)))]),
                     pa.array([_packed(pa.array(bounds.astype(np.int32)))]), pa.array([classes[units[rare]].astype(np.int8).tobytes()], pa.binary())],
                    names=["chunk", "seq", "words", "bounds", "classes"])

    with short_batches(table.sparkSession, 1):
        return settle(table.mapInArrow(tidied(work), "chunk bigint, seq binary, words binary, bounds binary, classes binary"), "sequences")


def contexts(given: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``part, chunk, data``: per part and chunk, the words that are not frequent, their classes and the classes beside them,
    written; and the class bigrams, which come as rows without a part, one a task.

    ``given`` are the sequences with the classes that their words have now.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                seq = _unpacked(row["seq"])[0].to_numpy().astype(np.int64)
                words, bounds = _unpacked(row["words"])[0], _unpacked(row["bounds"])[0].to_numpy()
                classes = np.frombuffer(row["classes"], np.int8)
                c = np.concatenate([np.arange(CLASSES), classes])[seq]
                m += np.bincount(c[:-1] * CLASSES + c[1:], minlength=CLASSES * CLASSES)
                at = np.flatnonzero(seq >= CLASSES)
                word = (seq[at] - CLASSES) * SIDES
                pairs = np.concatenate([word + c[at - 1], word + CLASSES + c[at + 1]])
                # Narrow numbers are sorted in half the time.
                pair, n = np.unique(pairs.astype(np.int32) if len(words) * SIDES < 2**31 else pairs, return_counts=True)
                # A larger count is written as several.
                times = -(-n // MOST)
                last = np.cumsum(times) - 1
                entries = np.full((int(times.sum()), 2), MOST, np.uint8)
                entries[:, 0] = np.repeat(pair % SIDES, times)
                entries[last, 1] = n - (times - 1) * MOST
                ends = 2 * np.searchsorted(np.repeat(pair // SIDES, times), np.arange(len(words) + 1))
                offsets = pa.py_buffer(ends.astype(np.int32).tobytes())
                beside = pa.Array.from_buffers(pa.binary(), len(words), [None, offsets, pa.py_buffer(entries.tobytes())])
                columns = [words, pa.array(classes), beside]
                yield from _by_part(bounds, columns, pa.array([row["chunk"]]), names=("part", "chunk", "data"))
        none = [pa.array([None], pa.int32()), pa.array([None], pa.int64()), pa.array([m.astype("<i8").tobytes()], pa.binary())]
        yield pa.RecordBatch.from_arrays(none, names=["part", "chunk", "data"])

    with short_batches(given.sparkSession, 1):
        found = settle(given.mapInArrow(tidied(work), "part int, chunk bigint, data binary"), "contexts")

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                m += np.frombuffer(x, "<i8")
        seen = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(m[seen])], names=["pair", "n"])

    sums = found.where("part IS NULL").select("data").mapInArrow(added, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    m = np.zeros(CLASSES * CLASSES)
    m[sums["pair"].to_numpy()] = sums["n"].to_numpy()
    return found.where("part IS NOT NULL"), m.reshape(CLASSES, CLASSES)


# Counts beside a word, and occurrences of it, whose terms are read from tables.
TABLED, LOST = 8, 64


def tables(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What the same class bigrams give every word: the terms of the counts on its right and left, and of its occurrences."""
    counts, times = np.arange(TABLED + 1)[:, None, None], np.arange(LOST + 1.0)[:, None]
    rows, cols = m.sum(1), m.sum(0)
    return _f(m.T + counts) - _f(m.T), _f(m + counts) - _f(m), _f(rows + times) - _f(rows) + _f(cols + times) - _f(cols)


def _side_gains(beside: np.ndarray, other: np.ndarray, own: np.ndarray, m: np.ndarray, risen: np.ndarray) -> np.ndarray:
    """What the classes on one side of each word add to the likelihood of each class it may go to; ``m`` has the word's class first."""
    out = np.zeros(beside.shape)
    word, c = np.nonzero(beside)
    n, a = beside[word, c], own[word]
    # As if the word were in no class: its row loses its own counts, and its column those of the other side.
    tabled = (n <= TABLED) & (c != a)
    terms = np.empty((len(word), CLASSES))
    terms[tabled] = risen[n[tabled].astype(np.int64), c[tabled]]
    some = np.flatnonzero(~tabled)
    base = m.T[c[some]]
    base -= np.where((c == a)[some, None], other[word[some]], 0)
    base[np.arange(len(some)), a[some]] -= n[some]
    base = np.maximum(base, 0)
    terms[some] = _f(base + n[some, None]) - _f(base)
    at = np.flatnonzero(tabled)
    alone = np.maximum(m[a[at], c[at]] - n[at], 0)
    terms[at, a[at]] = _f(alone + n[at]) - _f(alone)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    if len(first):
        out[word[first]] = np.add.reduceat(terms, first, axis=0)
    return out


def gains(left: np.ndarray, right: np.ndarray, own: np.ndarray, m: np.ndarray, known: tuple | None = None) -> np.ndarray:
    """The class that raises the likelihood most, of each word alone: per word the classes before and after it, and its class.

    The class bigrams ``m`` count each word in its class, with the classes beside it as they are given; ``known`` are its tables.
    """
    here, own = np.arange(len(own)), own.astype(np.int64)
    on_right, on_left, lost = known or tables(m)
    gain = _side_gains(right, left, own, m, on_right)
    gain += _side_gains(left, right, own, m.T, on_left)
    r, l = right.sum(1), left.sum(1)
    # A word beside itself is taken off twice; no count is less than 0.
    within = m[own, own] - right[here, own] - left[here, own]
    word, b = np.nonzero((left > 0) & (right > 0))
    d = np.where(b == own[word], np.maximum(within[word], 0), m[b, b])
    x, y = right[word, b], left[word, b]
    gain[word, b] += _f(d + x + y) - _f(d + x) - _f(d + y) + _f(d)
    # Classes that are neither a word's own nor beside it keep their sums, so that their terms are in the table.
    few = (r == l) & (r <= LOST)
    apart = (left > 0) | (right > 0) | ~few[:, None]
    apart[here, own] = True
    word, b = np.nonzero(apart)
    off = np.where(b == own[word], r[word] + np.minimum(within[word], 0), 0)
    rows = m.sum(1)[b] - left[word, b] - off
    off = np.where(b == own[word], l[word] + np.minimum(within[word], 0), 0)
    cols = m.sum(0)[b] - right[word, b] - off
    own_terms = gain[word, b] - (_f(rows + r[word]) - _f(rows) + _f(cols + l[word]) - _f(cols))
    gain -= lost[np.where(few, r, 0).astype(np.int64)]
    gain[word, b] = own_terms
    best = gain.argmax(1)
    return np.where(gain[here, best] > gain[here, own], best, own)


# Words whose contexts are added up together.
TOGETHER = 250


def moved(found: DataFrame, m: np.ndarray) -> DataFrame:
    """``part, chunk, data``: the class of greatest gain of each word, for the words of each part and chunk in their order; and,
    in rows without a chunk, the words of the part, how often each occurs, these classes and those before; written."""
    sent = found.sparkSession.sparkContext.broadcast(m)

    def work(rows: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py()) for x in rows["data"]]
        coded = pa.chunked_array([x[0] for x in parts]).combine_chunks().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        own = np.zeros(len(words), np.int64)
        own[code] = np.concatenate([x[1].to_numpy() for x in parts])
        beside = pa.chunked_array([x[2] for x in parts]).combine_chunks()
        order = np.argsort(code, kind="stable")
        starts = np.searchsorted(code[order], np.arange(0, len(words) + TOGETHER, TOGETHER))
        best, n, known = np.zeros(len(words), np.int8), np.zeros(len(words), np.int64), tables(sent.value)
        for k, (a, b) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            first, here = k * TOGETHER, order[a:b]
            size = min(TOGETHER, len(words) - first)
            some = beside.take(pa.array(here))
            data, at = joined(some)
            of = np.repeat(code[here] - first, np.diff(at) // 2)
            pair = np.frombuffer(data, np.uint8).reshape(-1, 2)
            sums = np.bincount(of * SIDES + pair[:, 0], weights=pair[:, 1], minlength=size * SIDES).reshape(size, SIDES)
            n[first : first + size] = sums[:, CLASSES:].sum(1)  # something stands after every word
            best[first : first + size] = gains(sums[:, :CLASSES], sums[:, CLASSES:], own[first : first + size], sent.value, known)
        ends = np.cumsum([len(x[0]) for x in parts])[:-1]
        answers = [x.tobytes() for x in np.split(best[code], ends)]
        part = rows["part"][0].as_py()
        del beside, coded, order, starts
        give_back(cycles=False)
        return pa.table(
            {"part": pa.array([part] * (len(parts) + 1), pa.int32()), "chunk": pa.array([*rows["chunk"].to_pylist(), None], pa.int64()),
             "data": pa.array([*answers, _packed(words, pa.array(n), pa.array(best), pa.array(own.astype(np.int8)))], pa.binary())})

    return settle(found.groupBy("part").applyInArrow(work, "part int, chunk bigint, data binary"), "classes")


def reclassed(texts: DataFrame, after: DataFrame) -> DataFrame:
    """The sequences with the classes that their words have after a round."""
    ordered = F.array_sort(F.collect_list(F.struct("part", "data")))
    answers = after.where("chunk IS NOT NULL").groupBy("chunk").agg(ordered.alias("a"))
    joined = texts.withColumnRenamed("classes", "__before").join(answers, "chunk", "left")
    # Parts are in the order of the words; a chunk without such words has no answers.
    given = F.aggregate(F.col("a.data"), F.lit(b"").cast("binary"), lambda x, y: F.concat(x, y))
    return joined.select("chunk", "seq", "words", "bounds", F.coalesce(given, "__before").alias("classes"))


def _worded(parts: DataFrame, place: int) -> DataFrame:
    """``word, n, class`` of packed words, whose classes are at this place."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1).to_pylist():
                columns = _unpacked(x)
                yield pa.RecordBatch.from_arrays([columns[0], columns[1], columns[place].cast(pa.int32())], names=["word", "n", "class"])

    return parts.mapInArrow(tidied(work), "word string, n bigint, class int")


def _class_sizes(parts: DataFrame, place: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and number of the packed words of each class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(1).to_pylist():
                columns = _unpacked(x)
                c = columns[place].to_numpy()
                n = np.bincount(c, weights=columns[1].to_numpy(), minlength=CLASSES).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(n), pa.array(np.bincount(c, minlength=CLASSES))], names=["class", "n", "kinds"])

    sums = parts.mapInArrow(tidied(work), "class bigint, n bigint, kinds bigint").groupBy("class").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).toArrow()
    size, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    size[sums["class"].to_numpy()] = sums["n"].to_numpy()
    kinds[sums["class"].to_numpy()] = sums["kinds"].to_numpy()
    return size, kinds


# Packed words of a part that has none: words, occurrences, classes and classes before.
NONE = [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int8()), pa.array([], pa.int8())]


def answered(table: DataFrame, words: DataFrame, place: int, parts: int) -> DataFrame:
    """The chunks with ``answers``, counts and classes of their distinct words by part; a word that is not among the packed
    ``words`` has count 0 and class -1."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, given in zip(batch.column(0), batch.column(1), strict=True):
                given = _unpacked(given.as_py())[0]
                part, order = dealt(given, parts)
                bounds = np.searchsorted(part, np.arange(parts + 1))
                yield from _by_part(bounds, [given.take(pa.array(order))], pa.array([chunk.as_py()]), names=("part", "chunk", "data"))

    def look(asked: pa.Table, known: pa.Table) -> pa.Table:
        asks = [_unpacked(x.as_py())[0] for x in asked["data"]]
        met = pa.concat_arrays([pa.array([], pa.string()), *asks])
        # A part is one value; there is none of a part without training words.
        word, times, *classes = _unpacked(known["data"][0].as_py()) if len(known) else NONE
        at = pc.index_in(met, value_set=word)
        n = pc.fill_null(times.take(at), 0)
        classes = pc.fill_null(classes[place - 2].take(at), -1)
        ends = np.append(0, np.cumsum([len(x) for x in asks], dtype=np.int64)).tolist()
        data = [_packed(pa.concat_arrays([n.slice(a, b - a)]), pa.concat_arrays([classes.slice(a, b - a)])) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        del asks, met, word, times, classes, at, n
        give_back(cycles=False)
        return pa.table({"part": asked["part"], "chunk": asked["chunk"], "data": pa.array(data, pa.binary())})

    with short_batches(table.sparkSession, 1):
        asked = settle(table.select("chunk", "words").mapInArrow(tidied(ask), "part int, chunk bigint, data binary"), "asked")
    found = asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(look, "part int, chunk bigint, data binary")
    answers = settle(found, "answers")
    discard(asked)
    ordered = F.array_sort(F.collect_list(F.struct("part", "data")))
    # A chunk whose texts have no words asks for nothing.
    return table.join(answers.groupBy("chunk").agg(ordered.alias("a")), "chunk", "left").select(*table.columns, F.col("a.data").alias("answers"))


def _known(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and classes of a chunk's distinct words, in their order."""
    words = row["words"]
    n, classes = np.zeros(len(words)), np.full(len(words), -1, np.int8)
    if row["answers"].is_valid:
        _, order = dealt(words, parts)
        got = [_unpacked(x.as_py()) for x in row["answers"]]
        n[order] = np.concatenate([x[0].to_numpy() for x in got])
        classes[order] = np.concatenate([x[1].to_numpy() for x in got])
    return n, classes


def fit(spark: SparkSession, table: DataFrame, counts: DataFrame) -> ClassModel:
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(WORDS).toArrow()
    frequent = top["word"].combine_chunks().cast(pa.string())
    sent = spark.sparkContext.broadcast(frequent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0)
            unit = np.where(pc.equal(words, END).to_numpy(zero_copy_only=False), 0, units_of(words, sent.value))
            n, seen = np.zeros(UNITS, np.int64), np.bincount(unit, minlength=UNITS)
            np.add.at(n, unit, batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(UNITS)), pa.array(n), pa.array(seen)], names=["unit", "n", "words"])

    sums = counts.mapInArrow(tidied(work), "unit bigint, n bigint, words bigint").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    got = sums.toArrow()
    total, kinds = np.zeros(UNITS), np.zeros(UNITS)
    total[got["unit"].to_numpy()] = got["n"].to_numpy()
    kinds[got["unit"].to_numpy()] = got["words"].to_numpy()

    bigrams = unit_bigrams(table, frequent)
    classes, rounds = _unit_classes(bigrams, total)
    discard(bigrams)
    parts = parts_of(table)
    texts, best, place = sequences(table, frequent, classes, parts), None, 2
    found, m = contexts(texts)
    word_rounds = [likelihood(m)]
    while kinds[1 + WORDS :].any():
        after = moved(found, m)
        discard(found)
        found, m_after = contexts(reclassed(texts, after))
        word_rounds.append(likelihood(m_after))
        gain = word_rounds[-1] - word_rounds[-2]
        if gain > 0:
            if best is not None:
                discard(best)
            best, m = after, m_after
        if gain <= SETTLED * abs(word_rounds[-2]):
            # Where not even the first round raised the likelihood, the classes before it stay.
            best, place = (after, 3) if best is None else (best, 2)
            break
    discard(found)
    discard(texts)
    packed = spark.createDataFrame([], "part int, data binary") if best is None else best.where("chunk IS NULL").select("part", "data")

    size = np.bincount(classes[: 1 + WORDS], weights=total[: 1 + WORDS], minlength=CLASSES)
    # Members of a class: its units, of which endings stand for words never seen, and its training words.
    members = np.bincount(classes, minlength=CLASSES).astype(float)
    more, kinds_more = _class_sizes(packed, place)
    size, members = size + more, members + kinds_more
    share = (size + 1) / (size.sum() + CLASSES)
    transition = (m + TRANSITION_PRIOR * share) / (m.sum(1, keepdims=True) + TRANSITION_PRIOR)
    log_size = np.log10(size + ADDED * members)
    alone = np.where(np.arange(UNITS) > WORDS, 0, total)
    log_unit = np.log10(alone + ADDED) - log_size[classes]
    return ClassModel(frequent, classes, np.log10(transition), log_unit, log_size, int(total.sum()), int(kinds.sum()), int(total[0]), rounds, word_rounds, total[1 : 1 + WORDS], parts, packed, place)


# Tokens that are scored together; a longer text is scored alone.
SCORED = 200_000


def _per_text(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of the values of texts of these sizes, one after the other."""
    running = np.append(0, np.cumsum(values))
    at = np.append(0, np.cumsum(sizes))
    return running[at[1:]] - running[at[:-1]]


def scored(spark: SparkSession, table: DataFrame, counts: DataFrame, model: ClassModel) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text."""
    parts, joined = model.parts, answered(table, model.packed, model.place, model.parts)
    sent = spark.sparkContext.broadcast(replace(model, packed=None))
    kind = table.schema["ids"].dataType.elementType.simpleString()
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        end_count = model.end_count
        base_all = np.log10(model.train_tokens + 0.5 * (model.vocabulary + 1))
        for batch in batches:
            for row, codes, sizes, train in _rows(batch):
                words = row["words"]
                n, given = _known(row, parts)
                unit = units_of(words, model.frequent)
                n = np.where(unit > WORDS, n, model.alone[np.clip(unit - 1, 0, WORDS - 1)])
                # A word has its own class where training gave one, else that of its unit.
                of = np.where((unit > WORDS) & (given >= 0), given, model.classes[unit])
                # The end is one more code.
                own = np.append(np.where(unit > WORDS, np.log10(n + ADDED) - model.log_size[of], model.log_unit[unit]), model.log_unit[0])
                of = np.append(of, model.classes[0]).astype(np.int8)
                seen, alone = n > 0, np.log10(n + 0.5)
                del unit, given, n
                at = np.append(0, np.cumsum(sizes))
                for a, b in slices(sizes + 1, SCORED):
                    some, size = codes[at[a] : at[b]], sizes[a:b]
                    seq, ends = _sequence(np.arange(len(words), dtype=np.int32), some, size, len(words))
                    c = of[seq]
                    step = model.log_transition[c[:-1], c[1:]] + own[seq[1:]]
                    score = _per_text(step, size + 1)
                    known = _per_text(seen[some].astype(np.int64), size) + (end_count > 0)
                    tokens = size + 1
                    base = _per_text(alone[some], size) + np.log10(end_count + 0.5) - tokens * base_all
                    yield pa.RecordBatch.from_arrays(
                        [pa.concat_arrays([row["ids"].values.slice(a, b - a)]), pa.array(~train[a:b]), pa.array(tokens), pa.array(known.astype(np.int64)),
                         pa.array(np.full(len(size), model.train_tokens)), pa.array(base), pa.array(score), pa.array(10 ** (-score / tokens))], names=names)
                del row, codes, words, own, of, seen, alone, some, seq, c, step
                give_back(cycles=False)

    schema = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double"
    # A chunk at a time goes to Python.
    with short_batches(spark, 1):
        return settle(joined.mapInArrow(tidied(work), schema), "scores")


def model_scores(spark: SparkSession, documents: DataFrame) -> DataFrame:
    """Train on the texts whose boolean column ``train`` is true, and score all."""
    table = chunks(documents, "train")
    counts = word_counts(table)
    return scored(spark, table, counts, fit(spark, table, counts))
