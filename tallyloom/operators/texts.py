"""Plain texts: normalisation and literal placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.text import defuse, squeeze_space


def normalize_text(docs: DataFrame, text: str = "text", longest: int = 128) -> DataFrame:
    """Texts of white space only dropped, whitespace runs cut to ``longest``, ``text_id`` = hash of the result."""
    kept = docs.filter(F.col(text).rlike(r"\S")).withColumn(text, squeeze_space(F.col(text), longest))
    return kept.withColumn("text_id", F.md5(text))


def sanitize(rows: DataFrame, text: str = "text", literals: tuple[str, ...] = M.PLACEHOLDERS) -> DataFrame:
    """Literal placeholder tokens broken by a space, so an embedder reads them as text."""
    return rows.withColumn(text, defuse(F.col(text), literals))
