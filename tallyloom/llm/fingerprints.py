"""Document fingerprints: one-permutation MinHash with optimal densification, packed low-order bits and bias correction.

All native. The five-word shingles of a text (with fewer words: the whole sequence as one) are hashed once. The upper bits
of a hash name its bin, and a bin keeps its smallest hash. An empty bin borrows from the first filled bin on a walk over all
bins that is its own (optimal densification: every filled bin is equally likely, and equal sets borrow alike). Each bin keeps
the lowest eight bits; they are packed into one base-64 text. Two fingerprints that agree in ``m`` of ``k`` bins have the
likeness ``(m/k - c) / (1 - c)``, where ``c = 2**-8`` is the share of bins that agree by chance, kept within 0 and 1.

A text without words, or null, has the empty fingerprint; it is like another empty one (1) and unlike all others (0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.once import let, pinned
from ..functions.text import ngram_hashes
from ..session import settle
from .common import text_of, word_array

SHINGLE = 5
BIN_BITS = 8
BINS = 1 << BIN_BITS
KEPT_BITS = 8
# Steps of an empty bin's walk that are tried one by one before the rest of the walk is searched.
TRIES = 10
_REST = 64 - BIN_BITS
_LARGEST = (1 << _REST) - 1


def shingle_hashes(words: Column, size: int = SHINGLE) -> Column:
    """Hashes of the overlapping shingles; the hash of all words when there are fewer; empty without words."""
    return (
        F.when(F.size(words) >= size, ngram_hashes(words, size))
        .when(F.size(words) > 0, F.array(F.xxhash64(words)))
        .otherwise(F.array().cast("array<bigint>"))
    )


def _walk(bin_: Column, step: Column | int) -> Column:
    """Bin reached after ``step`` steps of a bin's own walk, which visits every bin once in ``BINS`` steps."""
    h = F.xxhash64(bin_, F.lit("walk"))
    stride = h.bitwiseOR(F.lit(1))
    return F.pmod(F.shiftright(h, 32) + F.pmod(stride, F.lit(BINS)) * step, F.lit(BINS)).cast("int")


def sketch(hashes: Column) -> Column:
    """Low-order bits of every bin, densified; ``hashes`` must not be empty."""
    # One mark per bin, larger than any hash in it, so that every bin is present in the sorted hashes.
    marks = F.array(*[F.lit((b << _REST) | _LARGEST) for b in range(-BINS // 2, BINS // 2)])

    def smallest(ordered: Column) -> Column:
        return F.filter(
            ordered,
            lambda x, i: (i == 0) | (F.shiftright(x, _REST) != F.shiftright(F.get(ordered, i - 1), _REST)),
        )

    def dense(kept: Column) -> Column:
        def borrowed(i: Column) -> Column:
            near = [F.get(kept, _walk(i, t)) for t in range(1, TRIES + 1)]
            rest = F.filter(
                F.transform(F.sequence(F.lit(TRIES + 1), F.lit(BINS)), lambda t: F.get(kept, _walk(i, t))),
                lambda x: x.isNotNull(),
            )
            return F.coalesce(*near, F.get(rest, F.lit(0)))

        return F.transform(kept, lambda x, i: F.coalesce(x, borrowed(i)))

    firsts = let(F.sort_array(F.concat(hashes, marks)), smallest)
    low = F.transform(
        firsts,
        lambda x: F.when(x.bitwiseAND(F.lit(_LARGEST)) != _LARGEST, x.bitwiseAND(F.lit((1 << KEPT_BITS) - 1)).cast("int")),
    )
    return let(low, dense)


def packed(bits: Column) -> Column:
    text = F.base64(F.unhex(F.array_join(F.transform(bits, lambda x: F.lpad(F.hex(x), 2, "0")), "")))
    return F.translate(text, "\r\n", "")


def fingerprint(words: Column) -> Column:
    return let(shingle_hashes(words), lambda h: F.when(F.size(h) > 0, packed(sketch(h))).otherwise(F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated similarity of two fingerprints' shingle sets, corrected for bins that agree by chance."""

    def equal(pair: Column) -> Column:
        x, y = pair["a"], pair["b"]
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(BINS)),
            F.lit(0),
            lambda n, i: n + (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1))).cast("int"),
        )

    chance = 2.0**-KEPT_BITS
    share = let(F.struct(F.unbase64(a).alias("a"), F.unbase64(b).alias("b")), equal) / F.lit(float(BINS))
    corrected = F.greatest(F.lit(0.0), (share - chance) / (1 - chance))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(corrected)


def fingerprints(rows: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep`` columns and, for every named text column, its fingerprint under the new name."""
    cut = pinned(rows, {f"__w_{new}": word_array(text_of(F.col(old))) for new, old in texts.items()}, keep)
    return pinned(cut, {new: fingerprint(F.col(f"__w_{new}")) for new in texts}, keep)


# The place of a row without an id: before all others.
NO_ID = -(2**63)


def followers(rows: DataFrame) -> DataFrame:
    """``place, next, need``: every place, the place after it (after the last: the first), and the code points it needs.

    Places are dealt into ranges; only the first place of each range is looked at across ranges.
    """
    quarter = F.floor(F.length("text") / 4)
    places = settle(
        rows.groupBy("place").agg(F.max(quarter).alias("need")).repartitionByRange("place").withColumn("part", F.spark_partition_id()),
        "places",
    )
    firsts = places.groupBy("part").agg(F.min("place").alias("first"))
    every = W.orderBy("part").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    later = firsts.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), F.min("first").over(every)).alias("after"))
    inside = W.partitionBy("part").orderBy("place")
    return (
        places.withColumn("lead", F.lead("place").over(inside))
        .join(later, "part")
        .select("place", F.coalesce("lead", "after").alias("next"), "need")
    )


def edited_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has the last quarter (rounded down) of the code points replaced by the first as many, or all, of the next
    document's, by ascending id; a missing id comes first. Rows that share an id are each followed by the next id; where the
    next id has several rows, the text with the smallest hash is used.
    """
    place = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID))
    rows = documents.select(place.alias("place"), text_of(F.col("text")).alias("text"))
    order = settle(followers(rows), "followers")
    asked = order.select(F.col("next").alias("place"), F.col("place").alias("asker"), "need")
    heads = (
        rows.join(asked, "place")
        .select("asker", F.struct(F.xxhash64("text").alias("h"), F.substr("text", F.lit(1), F.col("need").cast("int")).alias("head")).alias("s"))
        .groupBy(F.col("asker").alias("place"))
        .agg(F.min("s")["head"].alias("head"))
    )
    n, quarter = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    pairs = rows.join(heads, "place").select(
        "place",
        n.cast("bigint").alias("n_chars"),
        F.xxhash64("text").alias("h"),
        "text",
        F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("head", F.lit(1), quarter)).alias("edited"),
    )
    pairs = pairs.withColumn("edited_sha256", F.sha2("edited", 256))
    keep = ["place", "n_chars", "h", "edited_sha256"]
    made = settle(fingerprints(pairs, {"fingerprint": "text", "edited_fingerprint": "edited"}, keep), "fingerprints")
    one = made.groupBy("place").agg(F.min(F.struct("h", "fingerprint"))["fingerprint"].alias("next_fingerprint"))
    following = order.select("place", "next").join(one.withColumnRenamed("place", "next"), "next").select("place", "next_fingerprint")
    return made.join(following, "place").select(
        F.nullif("place", F.lit(NO_ID)).alias("doc_id"),
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
