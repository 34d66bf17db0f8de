"""Token rows: ``id, tokens, mask, n`` with one 0/1 flag per token (1 = written by the assistant).

``tokens`` may hold text or integer ids. Everything here is computed inside the row, so nothing is shuffled, except
vocabulary building and the exploded views, which say so.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.once import let, pinned
from ..functions.seeded import order_key
from ..functions.text import marked_tokens
from ..session import lookup_join
from .ordering import placed_by_id

# ---- building --------------------------------------------------------------------------------------------------


def tokenize(rows: DataFrame, text: str = "text", tokenizer=None) -> DataFrame:
    """Add ``tokens`` and ``n``. The default splits inside the JVM; ``tokenizer`` is a pandas UDF text -> array."""
    tokens = marked_tokens(F.col(text)) if tokenizer is None else tokenizer(F.col(text))
    return rows.withColumn("tokens", tokens).withColumn("n", F.size("tokens"))


def assistant_mask(tokens: Column, newline_tokens: int = 0) -> Column:
    """Assistant-only mask of a row of text tokens (tokens hold no spaces).

    A span starts after ``header assistant end-header`` (plus ``newline_tokens``) and runs up to and including the end of
    turn; an unfinished turn runs to the end of the row. The row is cut at the ends of turns; the first assistant header
    of a piece opens its span, so every character is looked at a fixed number of times.
    """
    header = f" {M.START_HEADER} assistant {M.END_HEADER} "
    skipped = 3 + newline_tokens

    def zeros(n: Column) -> Column:
        return F.array_repeat(F.lit(0).cast("tinyint"), n)

    def spaces(text: Column) -> Column:
        return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))

    def piece_mask(piece: Column, ended: Column) -> Column:
        # A piece is " a b c": as many spaces as tokens. ``ended`` is 1 when an end of turn follows it.
        at = F.instr(F.concat(piece, F.lit(" ")), header)
        n = spaces(piece) + ended
        lead = F.least(spaces(F.substring(piece, F.lit(1), at - 1)) + skipped, n)
        ones = let(lead, lambda k: F.concat(zeros(k), F.array_repeat(F.lit(1).cast("tinyint"), n - k)))
        return F.when(at == 0, zeros(n)).otherwise(ones)

    joined = F.concat(F.lit(" "), F.array_join(tokens, " "))
    pieces = F.split(joined, " " + re.escape(M.END_TURN) + "(?= |$)", -1)
    masks = let(
        pieces,
        lambda ps: F.flatten(F.transform(ps, lambda p, i: piece_mask(p, (i < F.size(ps) - 1).cast("int")))),
    )
    return F.when(F.size(tokens) > 0, masks).otherwise(F.array().cast("array<tinyint>"))


class IdTokenizer(NamedTuple):
    """A tokenizer whose tokens are integer ids: ``encode`` gives the ids of a text column, the rest are marker ids."""

    encode: Callable[[Column], Column]
    start_header: int
    assistant: tuple[int, ...]
    end_header: int
    end_turn: int
    newline_tokens: int = 1


def id_spans(ids: Column, t: IdTokenizer) -> Column:
    """Assistant spans ``array<struct<s,e>>`` of a row of ids, end exclusive.

    A span starts after ``header assistant end-header`` and the newline tokens and runs up to and including the next end of
    turn, or to the end of the row. A header inside a span opens none. The row is walked once, inside the row.
    """
    skipped = 2 + len(t.assistant) + t.newline_tokens

    def walk(row: Column) -> Column:
        def opens(i: Column) -> Column:
            at = F.get(row, i) == t.start_header
            for k, word in enumerate((*t.assistant, t.end_header)):
                at = at & F.coalesce(F.get(row, i + (k + 1)) == word, F.lit(False))
            return at

        def step(s: Column, i: Column) -> Column:
            # ``open`` is the start of an open span, or -1; nothing opens before ``free``.
            closes = (s["open"] >= 0) & (i >= s["open"]) & (F.get(row, i) == t.end_turn)
            starts = (s["open"] < 0) & opens(i)
            return F.struct(
                F.when(closes, F.lit(-1)).when(starts, i + skipped).otherwise(s["open"]).alias("open"),
                F.when(closes, F.concat(s["done"], F.array(F.struct(s["open"].alias("s"), (i + 1).alias("e"))))).otherwise(s["done"]).alias("done"),
            )

        start = F.struct(F.lit(-1).alias("open"), F.array().cast("array<struct<s:int,e:int>>").alias("done"))
        n = F.size(row)
        last = F.aggregate(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), start, step)
        return let(
            last,
            lambda s: F.when(
                (s["open"] >= 0) & (s["open"] < n), F.concat(s["done"], F.array(F.struct(s["open"].alias("s"), n.alias("e"))))
            ).otherwise(s["done"]),
        )

    return let(ids, walk)


def id_mask(ids: Column, spans: Column) -> Column:
    """The 0/1 mask of a row from its spans."""

    def run(value: int, n: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("tinyint"), n)

    def filled(s: Column) -> Column:
        pieces = F.transform(
            s, lambda p, i: F.concat(run(0, p["s"] - F.coalesce(F.get(s, i - 1)["e"], F.lit(0))), run(1, p["e"] - p["s"]))
        )
        return F.concat(F.flatten(pieces), run(0, F.size(ids) - F.coalesce(F.try_element_at(s, F.lit(-1))["e"], F.lit(0))))

    return let(spans, filled)


def id_rows(texts: DataFrame, t: IdTokenizer, key: str = "id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rendered texts to rows of integer ids with their assistant mask; a text without ids is dropped."""
    keep = keep or []
    rows = pinned(texts.withColumnRenamed(key, "id"), {"tokens": t.encode(F.col(text))}, ["id", *keep])
    spanned = pinned(rows.filter(F.size("tokens") > 0), {"__spans": id_spans(F.col("tokens"), t)}, ["id", *keep, "tokens"])
    masked = pinned(spanned, {"mask": id_mask(F.col("tokens"), F.col("__spans"))}, ["id", *keep, "tokens"])
    return masked.withColumn("n", F.size("tokens"))


def masked_rows(texts: DataFrame, key: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Rendered texts to token rows with their assistant mask."""
    keep = keep or []
    rows = pinned(texts.withColumnRenamed(key, "id"), {"tokens": marked_tokens(F.col(text))}, ["id", *keep])
    masked = pinned(rows, {"mask": assistant_mask(F.col("tokens"))}, ["id", *keep, "tokens"])
    return masked.withColumn("n", F.size("tokens"))


def build_vocab(tokens: DataFrame, size: int, reserved: tuple[str, ...] = ()) -> DataFrame:
    """``token, token_id`` of the reserved tokens, then the most frequent ones up to ``size``; ties by token.

    ``tokens`` has one ``token`` per row. Counting combines before the shuffle; only ``size`` rows are numbered.
    """
    spark = tokens.sparkSession
    top = (
        tokens.filter(~F.col("token").isin(*reserved) if reserved else F.lit(True))
        .groupBy("token")
        .agg(F.count("*").alias("cnt"))
        .orderBy(F.desc("cnt"), "token")
        .limit(size - len(reserved))
    )
    numbered = top.select(
        "token", (F.row_number().over(W.orderBy(F.desc("cnt"), "token")) - 1 + len(reserved)).cast("int").alias("token_id")
    )
    if not reserved:
        return numbered
    fixed = spark.createDataFrame([(t, i) for i, t in enumerate(reserved)], "token string, token_id int")
    return fixed.unionByName(numbered)


def encode(rows: DataFrame, vocab: DataFrame, bos: int, eos: int, unknown: int, tokens: str = "tokens") -> DataFrame:
    """Add ``input_ids``: opening id, the id of every token, closing id. A row without tokens has the two.

    Rows are placed by id once; the vocabulary (bounded by its size) is looked up there and the ids are put back in
    order without a second shuffle.
    """
    # Placed by id before the explode, the lookup and the regrouping both stay inside the task.
    placed = placed_by_id(rows.select("id", tokens))
    items = placed.select("id", F.posexplode_outer(tokens).alias("pos", "token"))
    found = lookup_join(items, vocab, ["token"], "left")
    ids = found.groupBy("id").agg(
        F.sort_array(
            F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(unknown)).alias("t"))))
        ).alias("p")
    )
    body = F.transform("p", lambda x: x["t"])
    return ids.select("id", F.concat(F.array(F.lit(bos)), body, F.array(F.lit(eos))).alias("input_ids"))


# ---- inside one row --------------------------------------------------------------------------------------------


def spans_of(mask: Column) -> Column:
    """Maximal runs of 1 as ``array<struct<s,e>>``, end exclusive."""

    def spans(m: Column) -> Column:
        at = F.sequence(F.lit(0), F.greatest(F.size(m) - 1, F.lit(0)))
        starts = F.filter(at, lambda i: (F.get(m, i) == 1) & (F.coalesce(F.get(m, i - 1), F.lit(0)) == 0))
        ends = F.filter(at, lambda i: (F.get(m, i) == 1) & (F.coalesce(F.get(m, i + 1), F.lit(0)) == 0))
        return F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), (e + 1).alias("e")))

    return let(mask, spans)


def mask_spans(rows: DataFrame) -> DataFrame:
    """One row per span: ``id, span, s, e``."""
    return rows.select("id", F.posexplode(spans_of(F.col("mask"))).alias("span", "p")).select(
        "id", "span", F.col("p.s").alias("s"), F.col("p.e").alias("e")
    )


def says_early(token: str, within: int = 400) -> Column:
    """Whether a token is among the first ``within`` of a row, where an agent's opening phrase stands."""
    return F.exists(F.slice("tokens", 1, within), lambda t: t == token)


def supervised(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, m: a + m.cast("int"))


def clip(rows: DataFrame, length: int) -> DataFrame:
    """Tokens and mask cut at ``length``; ``clipped`` counts the tokens cut off."""
    return rows.select(
        *[c for c in rows.columns if c not in ("tokens", "mask", "n", "clipped")],
        F.slice("tokens", 1, length).alias("tokens"),
        F.slice("mask", 1, length).alias("mask"),
        F.least("n", F.lit(length)).alias("n"),
        F.greatest(F.col("n") - length, F.lit(0)).alias("clipped"),
    )


def drop_unsupervised(rows: DataFrame) -> DataFrame:
    return rows.filter(F.exists("mask", lambda m: m == 1))


def length_filter(rows: DataFrame, low: int, high: int, inclusive: bool = True, length: str = "n") -> DataFrame:
    """Rows with ``low <= length <= high``; with ``inclusive=False`` a row of exactly ``high`` is dropped too."""
    n = F.col(length)
    return rows.filter((n >= low) & ((n <= high) if inclusive else (n < high)))


def prompt_before_first_span(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Tokens before the first supervised token, if their number is within [low, high], and the first span's length."""
    first = F.array_position("mask", F.lit(1).cast("tinyint")) - 1
    rest = F.slice("mask", F.col("prompt_tokens").cast("int") + 1, F.col("n"))
    gap = F.array_position(rest, F.lit(0).cast("tinyint"))
    return (
        rows.withColumn("prompt_tokens", first)
        .filter((F.col("prompt_tokens") >= low) & (F.col("prompt_tokens") <= high))
        .select(
            "id",
            F.slice("tokens", 1, F.col("prompt_tokens").cast("int")).alias("prompt"),
            "prompt_tokens",
            F.when(gap > 0, gap - 1).otherwise(F.size(rest)).cast("bigint").alias("reply_tokens"),
        )
    )


def prompt_before_last_span(rows: DataFrame, high: int) -> DataFrame:
    """Tokens before the last span; no row when there is no span, it starts at 0, or the prompt is longer than ``high``."""
    starts = F.transform(spans_of(F.col("mask")), lambda p: p["s"])
    return (
        pinned(rows, {"prompt_tokens": F.array_max(starts)}, ["id", "tokens"])
        .filter((F.col("prompt_tokens") > 0) & (F.col("prompt_tokens") <= high))
        .select("id", F.slice("tokens", 1, F.col("prompt_tokens")).alias("prompt"), "prompt_tokens")
    )


def match_opening(rows: DataFrame, marker: list[str], head: int) -> DataFrame:
    """Flag rows of at least ``head`` tokens whose first ``head`` tokens contain the marker sequence."""
    opening = F.concat(F.lit(" "), F.array_join(F.slice("tokens", 1, head), " "), F.lit(" "))
    needle = " " + " ".join(marker) + " "
    return rows.withColumn("matches", (F.col("n") >= head) & (F.instr(opening, needle) > 0))


def reasoning_mode(rows: DataFrame, head: int = 20) -> DataFrame:
    """nothink / think / none from the first ``head`` tokens."""
    opening = F.array_join(F.slice("tokens", 1, head), " ")
    mode = (
        F.when(F.instr(opening, "/nothink") > 0, F.lit("nothink"))
        .when(F.instr(opening, "/think") > 0, F.lit("think"))
        .otherwise(F.lit("none"))
    )
    return rows.withColumn("mode", mode)


def clip_left(rows: DataFrame, length: int, prefix: list[str]) -> DataFrame:
    """The last tokens of every row behind a fixed prefix, ``length`` in all; ``cut`` says whether tokens were lost."""
    room = length - len(prefix)
    last = F.when(
        F.size("tokens") > 0, F.slice("tokens", -F.least(F.lit(room), F.size("tokens")), F.lit(room))
    ).otherwise(F.col("tokens"))
    lead = F.array(*[F.lit(p) for p in prefix])
    return rows.withColumn("cut", F.size("tokens") > room).withColumn("tokens", F.concat(lead, last))


def to_labels(rows: DataFrame, ids: str = "input_ids") -> DataFrame:
    """``labels``: the id where supervised, else -100; ``attention_mask``: ones."""
    return rows.withColumn(
        "labels", F.zip_with(ids, "mask", lambda t, m: F.when(m == 1, t).otherwise(F.lit(-100)))
    ).withColumn("attention_mask", F.array_repeat(F.lit(1), F.size(ids)))


def to_layout(rows: DataFrame, layout: dict[str, tuple[str, str]]) -> DataFrame:
    """Cast and rename to a fixed layout, ``{new name: (old name, type)}``; other columns are dropped."""
    return rows.select(*[F.col(old).cast(kind).alias(new) for new, (old, kind) in layout.items()])


def row_stats(rows: DataFrame) -> DataFrame:
    """Per row: tokens, supervised tokens, assistant turns, headers, reasoning blocks, tool calls."""

    def occurrences(token: str) -> Column:
        return F.size(F.filter("tokens", lambda t: t == token))

    return rows.select(
        *[c for c in rows.columns if c not in ("tokens", "mask", "n")],
        F.col("n").alias("n_tokens"),
        supervised(F.col("mask")).alias("n_supervised"),
        F.size(spans_of(F.col("mask"))).alias("n_assistant"),
        occurrences(M.START_HEADER).alias("n_headers"),
        occurrences(M.START_THINK).alias("n_think"),
        occurrences(M.TOOL_CALL).alias("n_tool_calls"),
    )


def bad_rows(rows: DataFrame, length: int) -> DataFrame:
    """Rows that break an invariant, see ``sound``."""
    return rows.filter(~sound(length))


def sound(length: int, tokens: str = "tokens", mask: str = "mask", n: str = "n") -> Column:
    """Whether a row has equal lengths, at most ``length`` tokens, and a 0/1 mask with at least one 1."""
    return (
        (F.size(tokens) == F.size(mask))
        & (F.size(tokens) == F.col(n))
        & (F.col(n) <= length)
        & F.forall(mask, lambda m: m.isin(0, 1))
        & F.exists(mask, lambda m: m == 1)
    )


# ---- exploded views --------------------------------------------------------------------------------------------


def supervised_tokens(rows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One ``token`` per supervised position."""
    kept = let(F.col("mask"), lambda m: F.filter("tokens", lambda t, i: F.get(m, i) == 1))
    return rows.select(*(keep or []), F.explode(kept).alias("token"))


def token_freq(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Count of every supervised token; counts are combined in each task, so a hot token costs one row per task."""
    by = by or []
    return supervised_tokens(rows, by).groupBy(*by, "token").agg(F.count("*").alias("cnt"))


def sum_freq(*freqs: DataFrame) -> DataFrame:
    out = freqs[0]
    for f in freqs[1:]:
        out = out.unionByName(f)
    return out.groupBy("token").agg(F.sum("cnt").alias("cnt"))


def sample_positions(rows: DataFrame, k: int, tail: int, seed: int) -> DataFrame:
    """Up to ``k`` seeded positions per row, inside a span but not its first token, and not among the last ``tail``."""
    at = F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1)))
    inside = let(
        F.col("mask"),
        lambda m: F.filter(at, lambda i: (F.get(m, i) == 1) & (F.get(m, i - 1) == 1) & (i + F.lit(tail) < F.col("n"))),
    )
    # The k smallest keys are taken inside the row; nothing is exchanged.
    keyed = F.array_sort(
        F.transform(inside, lambda i: F.struct(order_key(seed, F.col("id"), i).alias("h"), i.alias("pos")))
    )
    return rows.select("id", F.explode(F.slice(keyed, 1, k)).alias("p")).select("id", F.col("p.pos").alias("pos"))


def marker_depth(rows: DataFrame, opening: str, closing: str) -> DataFrame:
    """One row per token with the running depth of open markers, ``id, pos, token, mask, depth``.

    Rows are placed by id once; exploding and the running sum keep that placement.
    """
    items = (
        placed_by_id(rows.select("id", "tokens", "mask"))
        .select("id", F.posexplode(F.arrays_zip("tokens", "mask")).alias("pos", "p"))
        .select("id", "pos", F.col("p.tokens").alias("token"), F.col("p.mask").alias("mask"))
    )
    step = F.when(F.col("token") == opening, 1).when(F.col("token") == closing, -1).otherwise(0)
    running = W.partitionBy("id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    return items.withColumn("depth", F.sum(step).over(running))
