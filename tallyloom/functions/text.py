"""Text expressions: tokens, reasoning blocks, solution blocks, whitespace."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markers as M
from .once import let


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(M.WORD_PATTERN), F.lit(0))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(M.WORD_PATTERN))


def marked_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(M.TOKEN_PATTERN), F.lit(0))


def marked_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(M.TOKEN_PATTERN))


def ngram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the overlapping n-grams, in order; empty when the row is shorter than ``n``.

    Tokens are hashed once and an n-gram is the hash of its ``n`` token hashes, so no n-gram text is ever built.
    """

    def grams(h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - n, F.lit(0)))
        hashed = F.transform(starts, lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(n)]))
        return F.when(F.size(h) >= n, hashed).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(tokens, lambda t: F.xxhash64(t)), grams)


def squeeze_space(text: Column, longest: int = 128) -> Column:
    """Whitespace runs longer than ``longest`` are cut to that length."""
    return F.regexp_replace(text, rf"(\s{{{longest}}})\s+", "$1")


def think_parts(content: Column) -> tuple[Column, Column]:
    """(reasoning, answer) of a reply that may open with ``<think>``; an unclosed block leaves the answer empty."""
    opened = F.startswith(content, F.lit("<think>"))
    body = F.substring(content, len("<think>") + 1, 2**30)
    close = F.instr(body, "</think>")
    head = F.when(close > 0, F.substr(body, F.lit(1), close - 1)).otherwise(body)
    tail = F.when(close > 0, F.substr(body, close + len("</think>"))).otherwise(F.lit(""))
    reasoning = F.when(opened, _strip(head)).otherwise(F.lit(""))
    answer = F.when(opened, _strip(tail)).otherwise(_strip(content))
    return reasoning, answer


def strip_think(content: Column) -> Column:
    return F.regexp_replace(content, r"(?s)<think>.*?</think>\s*", "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def solution_block(text: Column) -> Column:
    """Text between the last closer and the nearest opener before it; null when absent, empty or holding tags."""
    closer = F.length(text) - F.length(F.substring_index(text, "</solution>", -1)) - F.lit(len("</solution>"))
    has_close = F.instr(text, "</solution>") > 0
    before = F.when(has_close, F.substr(text, F.lit(1), closer))
    has_open = F.instr(before, "<solution>") > 0
    inner = F.when(has_open, _strip(F.substring_index(before, "<solution>", -1)))
    bad = (inner == "") | inner.rlike(M.SOLUTION_TAGS)
    return F.when(~bad, inner)


def defuse(text: Column, literals: tuple[str, ...] = M.PLACEHOLDERS) -> Column:
    """A space after the first character of every literal placeholder."""
    for literal in literals:
        text = F.replace(text, F.lit(literal), F.lit(literal[0] + " " + literal[1:]))
    return text
