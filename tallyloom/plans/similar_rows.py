"""The rows of a universe most similar to a set of prompts, under a token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import selection as S
from ..operators import similarity as N
from ..session import settle


def similar_subset(
    prompts: DataFrame, universe: DataFrame, k: int, budget: int, seed: int, dedup: bool = False, embedder=None
) -> DataFrame:
    """``round, query, rank, id, score, n`` of the rows taken. ``prompts``: ``query, text``; ``universe``: ``id, text, n``.

    A row that is taken for two prompts appears twice and so keeps its weight.
    """
    near = N.knn_topk(N.embed(prompts, "query", fn=embedder), N.embed(universe, "id", fn=embedder), k)
    return S.round_robin_select(settle(near, "near"), universe.select("id", "n"), budget, seed, dedup)
