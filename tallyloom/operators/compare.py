"""Comparing datasets: token classes, vocabulary coverage, unigram closeness, repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.once import pinned
from ..functions.text import ngram_hashes
from ..session import lookup_join
from .ordering import per_group_limit, placed_by_id


def token_class(token: Column) -> Column:
    """Class of a token; the first match wins."""
    name = F.lit("punctuation")
    for label, pattern in reversed(M.TOKEN_CLASSES):
        name = F.when(token.rlike(pattern), F.lit(label)).otherwise(name)
    return name


def token_classes(vocab: DataFrame) -> DataFrame:
    return vocab.withColumn("class", token_class(F.col("token")))


def class_hist(freq: DataFrame, by: list[str]) -> DataFrame:
    """Share of every token class, from a token frequency table (one classification per distinct token)."""
    counted = freq.groupBy(*by, token_class(F.col("token")).alias("class")).agg(F.sum("cnt").alias("cnt"))
    return counted.withColumn("share", F.col("cnt") / F.sum("cnt").over(W.partitionBy(*by)))


def vocab_coverage(freq: DataFrame, vocabs: DataFrame) -> DataFrame:
    """Share of the counted tokens each vocabulary holds. ``vocabs``: ``vocab, token``; every vocabulary in it is shown."""
    held = vocabs.join(freq.groupBy("token").agg(F.sum("cnt").alias("cnt")), "token", "left")
    total = freq.agg(F.sum("cnt").alias("t")).scalar()
    return held.groupBy("vocab").agg(F.sum(F.coalesce("cnt", F.lit(0))).alias("covered")).select(
        "vocab", total.alias("tokens"), "covered", (F.col("covered") / total).alias("coverage")
    )


def uncovered_classes(freq: DataFrame, vocabs: DataFrame) -> DataFrame:
    """Token classes of what each vocabulary misses: all counts of a class less those the vocabulary holds."""
    counts = freq.groupBy("token").agg(F.sum("cnt").alias("cnt")).withColumn("class", token_class(F.col("token")))
    every = counts.groupBy("class").agg(F.sum("cnt").alias("all"))
    held = vocabs.join(counts, "token").groupBy("vocab", "class").agg(F.sum("cnt").alias("held"))
    # One entry per class, put beside each vocabulary.
    classes = every.agg(F.collect_list(F.struct("class", "all")).alias("c")).scalar()
    wanted = vocabs.select("vocab").distinct().select("vocab", F.inline(classes))
    missed = wanted.join(held, ["vocab", "class"], "left").withColumn("cnt", F.col("all") - F.coalesce("held", F.lit(0)))
    return missed.filter("cnt > 0").select("vocab", "class", "cnt")


def top_uncovered(freq: DataFrame, vocabs: DataFrame, k: int, by: list[str]) -> DataFrame:
    """The ``k`` most frequent tokens each vocabulary misses, per group.

    A vocabulary of s tokens misses k of a group's k + s most frequent, so only those are put beside the vocabularies.
    """
    largest = vocabs.groupBy("vocab").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    top = per_group_limit(freq, by, [F.desc("cnt"), F.col("token")], k + largest, "__r").drop("__r")
    held = vocabs.groupBy("token").agg(F.collect_set("vocab").alias("__held"))
    wanted = vocabs.agg(F.collect_set("vocab").alias("v")).scalar()
    none = F.array().cast(vocabs.select(F.collect_set("vocab").alias("v")).schema["v"].dataType)
    missing = lookup_join(top, held, ["token"], "left").withColumn(
        "vocab", F.explode(F.array_except(wanted, F.coalesce("__held", none)))
    )
    return per_group_limit(missing, [*by, "vocab"], [F.desc("cnt"), F.col("token")], k).select(
        *by, "vocab", "token", "cnt", "rank"
    )


def draft_vocab(freq: DataFrame, size: int, universe: int, frozen: DataFrame | None = None) -> DataFrame:
    """The ``size`` most frequent ids (ties by lower id), padded with the lowest unused ids, sorted by id.

    ``freq``: ``token`` (integer id), ``cnt``. Columns: ``draft_idx, token, d2t`` with d2t = token - draft_idx. A frozen
    vocabulary (``token``) replaces the choice. Only ``size`` rows are numbered.
    """
    spark = freq.sparkSession
    if frozen is None:
        ranked = freq.orderBy(F.desc("cnt"), "token").limit(size).select(F.col("token").cast("bigint"))
        # Ids 0 .. 2*size always hold enough unused ones, so the padding never looks further.
        unused = spark.range(min(universe, 2 * size)).select(F.col("id").alias("token")).join(ranked, "token", "left_anti")
        pool = ranked.withColumn("pad", F.lit(0)).unionByName(unused.withColumn("pad", F.lit(1)))
        chosen = pool.orderBy("pad", "token").limit(size).select("token")
    else:
        chosen = frozen.select(F.col("token").cast("bigint"))
    idx = F.row_number().over(W.orderBy("token")) - 1
    return chosen.select(idx.cast("bigint").alias("draft_idx"), "token").withColumn("d2t", F.col("token") - F.col("draft_idx"))


def vocab_difference(own: DataFrame, frozen: DataFrame) -> DataFrame:
    """One row: ids shared by two vocabularies and ids of the first that the second lacks."""
    both = own.select("token").join(frozen.select("token", F.lit(1).alias("f")), "token", "left")
    return both.agg(F.count("f").alias("shared"), (F.count("*") - F.count("f")).alias("differing"))


def cross_entropy(eval_freq: DataFrame, model_freq: DataFrame, vocab_size: int, by: str = "eval_set") -> DataFrame:
    """Bits per token of each eval set's replies under each unigram model with add-0.5 smoothing.

    ``eval_freq``: ``<by>, token, cnt``; ``model_freq``: ``model, token, cnt``. All models are joined at once: what a model
    does not know costs the same bits everywhere, so only the tokens it knows are met.
    """
    shares = eval_freq.groupBy(by).agg(F.sum("cnt").alias("__all"))
    p = lookup_join(eval_freq, shares, [by]).withColumn("p", F.col("cnt") / F.col("__all")).select(by, "token", "p")
    known = model_freq.select("model", "token", F.log2(F.col("cnt") + 0.5).alias("bits"))
    met = p.join(known, "token").groupBy(by, "model").agg(F.sum(F.col("p") * F.col("bits")).alias("b"), F.sum("p").alias("known"))
    sizes = model_freq.groupBy("model").agg(F.sum("cnt").alias("n"))
    # One entry per model, put beside each eval set.
    models = sizes.agg(F.collect_list(F.struct("model", "n")).alias("m")).scalar()
    wanted = shares.select(by, F.inline(models))
    paired = wanted.join(met, [by, "model"], "left").withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("b", "known")})
    unknown = (1 - F.col("known")) * F.log2(F.lit(0.5))
    return paired.select(by, "model", (F.log2(F.col("n") + 0.5 * vocab_size) - F.col("b") - unknown).alias("bits"))


# ---- reasoning blocks and repetition inside a row --------------------------------------------------------------


def think_stats(rows: DataFrame, by: list[str], opening: str = M.START_THINK, closing: str = M.END_THINK) -> DataFrame:
    """Rows with a reasoning block, supervised tokens inside one, rows whose block never closes, first block length.

    Rows without a supervised token are left out of every figure.
    """
    # Everything is one pass inside the row: the running depth needs no neighbours from other rows.
    step = lambda t: F.when(t == opening, 1).when(t == closing, -1).otherwise(0)
    state = F.aggregate(
        F.arrays_zip("tokens", "mask"),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("inside")),
        lambda s, p: F.struct(
            (s["depth"] + step(p["tokens"])).alias("depth"),
            (
                s["inside"] + F.when((s["depth"] + step(p["tokens"]) > 0) & (p["mask"] == 1), 1).otherwise(0)
            ).alias("inside"),
        ),
    )
    open_at = F.array_position("tokens", F.lit(opening)).cast("int")
    rest = F.slice("tokens", F.greatest("open_at", F.lit(1)), F.size("tokens"))
    per_row = (
        rows.filter(F.exists("mask", lambda m: m == 1)).select("tokens", *by, state.alias("st"), open_at.alias("open_at"))
        .filter("open_at > 0")
        .withColumn("close_at", F.array_position(rest, F.lit(closing)))
    )
    first_len = F.when(F.col("close_at") > 0, F.col("close_at") - 1).otherwise(F.size("tokens") - F.col("open_at") + 1)
    return per_row.groupBy(*by).agg(
        F.count("*").alias("think_rows"),
        F.sum("st.inside").alias("think_tokens"),
        F.count_if(F.col("st.depth") > 0).alias("unclosed"),
        F.sum(first_len).alias("first_block_tokens"),
    )


def repeated_ngrams(rows: DataFrame, n: int = 8) -> DataFrame:
    """``id, pos, first, from_reply`` of every n-gram that occurred earlier in its row.

    ``first`` is its first position; ``from_reply`` says whether that earlier copy ends in supervised text. Rows are
    placed by id once; the first occurrence is found inside that placement.
    """
    placed = placed_by_id(rows.select("id", "tokens", "mask"))
    grams = placed.select("id", "mask", F.posexplode(ngram_hashes(F.col("tokens"), n)).alias("pos", "gram")).select(
        "id", "pos", "gram", F.element_at("mask", F.col("pos") + n).alias("end_mask")
    )
    same = W.partitionBy("id", "gram").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    firsts = grams.withColumn("first", F.first("pos").over(same)).withColumn("m", F.first("end_mask").over(same))
    return firsts.filter(F.col("pos") > F.col("first")).select(
        "id", "pos", "first", (F.col("m") == 1).alias("from_reply")
    )


def copy_shares(rows: DataFrame, by: list[str], n: int = 8, least: int = 16) -> DataFrame:
    """Supervised tokens covered by an n-gram seen earlier in the row, split into context and own-reply copies.

    Context wins where both cover a token. Rows shorter than ``least`` tokens have no copies.
    """
    long_rows = rows.filter(F.col("n") >= least)
    found = repeated_ngrams(long_rows, n).groupBy("id").agg(
        F.collect_list(F.when(~F.col("from_reply"), F.col("pos"))).alias("ctx"),
        F.collect_list(F.when(F.col("from_reply"), F.col("pos"))).alias("own"),
    )
    joined = rows.select("id", "mask", *by).join(found, "id", "left")
    none = F.array().cast("array<int>")

    def covered(starts: Column) -> Column:
        reach = F.flatten(F.transform(starts, lambda p: F.sequence(p, p + (n - 1))))
        return F.array_distinct(F.coalesce(reach, none))

    reach = pinned(joined, {"c": covered(F.col("ctx")), "o": covered(F.col("own"))}, ["mask", *by])
    counted = reach.select(
        *by,
        F.aggregate("mask", F.lit(0), lambda a, m: a + m.cast("int")).alias("sup"),
        F.size(F.filter("c", lambda p: F.get("mask", p) == 1)).alias("c"),
        F.size(F.filter(F.array_except("o", "c"), lambda p: F.get("mask", p) == 1)).alias("s"),
    )
    return counted.groupBy(*by).agg(
        F.sum("sup").alias("supervised"),
        F.sum("c").alias("from_context"),
        F.sum("s").alias("from_reply"),
    )
