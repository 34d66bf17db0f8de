"""Regenerated replies: splicing into rows, the next prompts, merging, and the cost of layouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.once import pinned
from ..functions.seeded import order_key
from .token_rows import spans_of


def _with_replies(rows: DataFrame, replies: DataFrame) -> DataFrame:
    """``id, tokens, n_spans, gaps, replies, before``: the text around the spans, the replies in turn order, and the
    length of the rebuilt row when each reply is about to start.

    A row has as many replies as it has assistant turns, so the list is bounded by the row.
    """
    turns = replies.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("k", "reply", "finish"))).alias("replies"))
    none = F.array().cast(turns.schema["replies"].dataType)
    joined = pinned(
        rows.join(turns, "id", "left"),
        {"spans": spans_of(F.col("mask")), "replies": F.coalesce("replies", none)},
        ["id", "tokens"],
    )
    n_spans = F.size("spans")

    def gap(i: Column) -> Column:
        start = F.when(i > 0, F.get("spans", i - 1)["e"]).otherwise(F.lit(0))
        end = F.coalesce(F.get("spans", i)["s"], F.size("tokens"))
        return F.slice("tokens", start + 1, end - start)

    cut = pinned(
        joined,
        {"n_spans": n_spans, "gaps": F.transform(F.sequence(F.lit(0), n_spans), gap)},
        ["id", "tokens", "replies"],
    )

    def length_before(k: Column) -> Column:
        gaps = F.aggregate(F.slice("gaps", F.lit(1), k + 1), F.lit(0), lambda a, g: a + F.size(g))
        done = F.aggregate(F.slice("replies", F.lit(1), k), F.lit(0), lambda a, r: a + F.size(r["reply"]))
        return gaps + done

    return pinned(
        cut,
        {"before": F.transform(F.sequence(F.lit(0), F.col("n_spans")), length_before)},
        ["id", "tokens", "n_spans", "gaps", "replies"],
    )


def splice_replies(rows: DataFrame, replies: DataFrame, max_total: int) -> DataFrame:
    """Every span replaced by its reply, the text between spans kept.

    Stops after a reply that did not finish by itself (``capped``) or before a turn that no longer fits (``total_len``);
    the row is cut at ``max_total``. Rows without spans are ``no_assistant_turn``; rows still waiting for a reply are left
    out. ``replies``: ``id, k, reply, finish``. Returns ``id, tokens, spans, n_regenerated, status``.
    """
    n_spans = F.col("n_spans")
    turns = F.sequence(F.lit(0), F.greatest(n_spans - 1, F.lit(0)))
    full = F.array_min(F.filter(turns, lambda k: F.get("before", k) >= max_total - 1))
    cap = F.array_min(F.transform(F.filter("replies", lambda r: r["finish"] != "stop"), lambda r: r["k"].cast("int")))
    base = pinned(
        _with_replies(rows, replies),
        {"full": F.coalesce(full, n_spans), "cap": F.coalesce(cap, n_spans)},
        ["id", "n_spans", "gaps", "replies", "before"],
    )
    capped = F.col("cap") < F.col("full")
    status = (
        F.when(n_spans == 0, "no_assistant_turn")
        .when(capped, "capped")
        .when(F.col("full") < n_spans, "total_len")
        .otherwise("complete")
    )
    used = F.when(n_spans == 0, 0).when(capped, F.col("cap") + 1).otherwise(F.col("full"))
    ready = pinned(base, {"status": status, "used": used}, ["id", "gaps", "replies", "before"]).filter(
        F.size(F.filter("replies", lambda r: r["k"] < F.col("used"))) == F.col("used")
    )
    each = F.slice(F.sequence(F.lit(0), F.greatest(F.col("used"), F.lit(1))), F.lit(1), F.col("used"))
    pieces = F.flatten(F.transform(each, lambda k: F.concat(F.get("gaps", k), F.get("replies", k)["reply"])))
    tail = F.when(F.col("status") == "capped", F.array().cast("array<string>")).otherwise(F.get("gaps", F.col("used")))
    made = F.transform(
        each,
        lambda k: F.struct(
            F.get("before", k).alias("s"),
            F.least(F.get("before", k) + F.size(F.get("replies", k)["reply"]), F.lit(max_total)).alias("e"),
        ),
    )
    return ready.select(
        "id",
        F.slice(F.concat(pieces, tail), 1, max_total).alias("tokens"),
        F.filter(made, lambda p: p["s"] < max_total).alias("spans"),
        F.col("used").alias("n_regenerated"),
        "status",
    )


def next_prompts(
    rows: DataFrame, replies: DataFrame, k: int, max_total: int, max_new: int, seed: int
) -> DataFrame:
    """Prompts to generate in round ``k``: rows whose earlier replies are all there and let the row go on.

    Rounds with an error have no reply yet and stay out until it is retried.
    """
    earlier = replies.filter(F.col("k") < k)
    base = _with_replies(rows, earlier).withColumn("prompt_tokens", F.get("before", F.lit(k)))
    going = (
        (F.col("n_spans") > k)
        & (F.size("replies") == k)
        & F.forall("replies", lambda r: r["finish"] == "stop")
        & (F.col("prompt_tokens") < max_total - 1)
    )
    prompt = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(k)),
            lambda i: F.concat(
                F.when(i > 0, F.get("replies", i - 1)["reply"]).otherwise(F.array().cast("array<string>")), F.get("gaps", i)
            ),
        )
    )
    request = (F.lit(seed * 1000003) + F.col("id").cast("bigint") * 131 + k).bitwiseAND(F.lit(0x7FFFFFFF))
    return base.filter(going).select(
        "id",
        F.lit(k).alias("k"),
        "prompt_tokens",
        F.least(F.lit(max_new), F.lit(max_total) - F.col("prompt_tokens")).alias("max_tokens"),
        request.alias("request_seed"),
        prompt.alias("prompt"),
    )


def generate(prompts: DataFrame, fn, retries: int = 3) -> DataFrame:
    """Run a reply generator over Arrow batches of prompts: ``id, k, reply, finish, error``.

    ``fn(prompts, max_tokens, request_seeds)`` gets lists for a whole batch and returns ``(tokens, finish)`` for each, or the
    exception of the prompts that failed. Those are handed in again, up to ``retries`` times; what still fails keeps its
    whole error text. A call that raises counts as a failure of all its prompts.
    """

    def run(batches):
        import pandas as pd

        for part in batches:
            results: list = [None] * len(part)
            todo = list(range(len(part)))
            for _ in range(retries + 1):
                if not todo:
                    break
                some = part.iloc[todo]
                try:
                    made = fn([list(p) for p in some["prompt"]], some["max_tokens"].tolist(), some["request_seed"].tolist())
                except Exception as e:  # noqa: BLE001 - the error is data
                    made = [e] * len(todo)
                for i, result in zip(todo, made, strict=True):
                    results[i] = result
                todo = [i for i, result in zip(todo, made, strict=True) if isinstance(result, Exception)]
            failed = [isinstance(r, Exception) for r in results]
            yield pd.DataFrame(
                {
                    "id": part["id"],
                    "k": part["k"],
                    "reply": [None if bad else r[0] for r, bad in zip(results, failed, strict=True)],
                    "finish": [None if bad else r[1] for r, bad in zip(results, failed, strict=True)],
                    "error": [f"{type(r).__name__}: {r}" if bad else None for r, bad in zip(results, failed, strict=True)],
                }
            )

    id_type = prompts.schema["id"].dataType.simpleString()
    return prompts.mapInPandas(run, f"id {id_type}, k int, reply array<string>, finish string, error string")


def error_share_guard(results: DataFrame, most: float) -> None:
    """Stop when more than this share of the prompts failed."""
    share = results.agg((F.count("error") / F.count("*")).alias("s")).first().s
    if share is not None and share > most:
        raise ValueError(f"{share:.1%} of the prompts failed")


def merge_parts(parts: DataFrame, seed: int) -> DataFrame:
    """Training rows from parts: mask from the spans, rows without spans dropped, seeded order column."""
    # Masks are assembled span by span, so the cost is linear in the row.
    last = F.get("spans", F.size("spans") - 1)["e"]
    lead = F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.size("spans") - 1),
            lambda i: F.concat(
                F.array_repeat(
                    F.lit(0).cast("tinyint"),
                    F.get("spans", i)["s"] - F.when(i > 0, F.get("spans", i - 1)["e"]).otherwise(F.lit(0)),
                ),
                F.array_repeat(F.lit(1).cast("tinyint"), F.get("spans", i)["e"] - F.get("spans", i)["s"]),
            ),
        )
    )
    mask = F.concat(lead, F.array_repeat(F.lit(0).cast("tinyint"), F.size("tokens") - last))
    return parts.filter(F.size("spans") > 0).select(
        "id", "tokens", mask.alias("mask"), F.size("tokens").alias("n"), order_key(seed, "id").alias("h")
    )


def layout_inflation(parts: DataFrame, length: int) -> DataFrame:
    """Tokens with one row per conversation against one row per reply, for all rows and multi-turn rows only."""
    ends = F.transform("spans", lambda p: F.least(p["e"], F.lit(length)))
    sized = parts.filter(F.size("spans") > 0).select(
        F.least(F.size("tokens"), F.lit(length)).alias("c"),
        F.aggregate(ends, F.lit(0), lambda a, e: a + e).alias("b"),
        F.size("spans").alias("g"),
    )
    many = F.col("g") > 1
    return sized.agg(
        F.count("*").alias("n_rows"),
        F.sum("g").alias("replies"),
        F.sum("c").alias("per_conversation"),
        F.sum("b").alias("per_reply"),
        (F.sum("b") / F.sum("c")).alias("ratio"),
        (F.sum(F.when(many, F.col("b"))) / F.sum(F.when(many, F.col("c")))).alias("multi_turn_ratio"),
    )
