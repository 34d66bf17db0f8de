"""Assistant replies regenerated turn by turn with a reply generator."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import regen as R
from ..session import settle


def regenerate(
    rows: DataFrame, fn, max_total: int, max_new: int, seed: int, most_errors: float = 0.02, retries: int = 3
) -> DataFrame:
    """Parts ``id, tokens, spans, n_regenerated, status``; every round asks for one more reply of the rows that go on.

    Rounds are as many as the longest conversation has turns. Replies of a round are written before the next one starts,
    so a lost executor costs at most a part of a round. Rows whose prompt kept failing are left out; too many of them
    stop the job.
    """
    rows = settle(rows.select("id", "tokens", "mask", "n"), "rows")
    id_type = rows.schema["id"].dataType.simpleString()
    replies = rows.sparkSession.createDataFrame([], f"id {id_type}, k int, reply array<string>, finish string")
    k = 0
    while True:
        prompts = R.next_prompts(rows, replies, k, max_total, max_new, seed)
        made = settle(R.generate(prompts, fn, retries), "replies")
        if made.isEmpty():
            return R.splice_replies(rows, replies, max_total)
        R.error_share_guard(made, most_errors)
        replies = replies.unionByName(made.filter(F.col("error").isNull()).drop("error"))
        k += 1
