"""Registry of queries and their SQL, and the inputs and SQL fragments they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.seeded import key_fraction, order_key
from ..functions.text import word_count, words
from ..operators.conversations import render
from ..operators.token_rows import masked_rows
from ..session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SEED = 7


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: _wide_integers(fn(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def _wide_integers(df: DataFrame) -> DataFrame:
    """Integer columns as bigint, the type SQL counts have."""
    narrow = [f.name for f in df.schema.fields if f.dataType.typeName() in ("byte", "short", "integer")]
    return df.withColumns({name: F.col(name).cast("bigint") for name in narrow}) if narrow else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows over all cores when the files give fewer splits than there are cores; large inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


# ---- shared inputs ---------------------------------------------------------------------------------------------


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised texts: ``id, source, lang, text``."""
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "lang", "text"))


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``source, id, n`` as a written statistics table: texts are tokenised once."""
    return settle(docs(spark, sf_dir).select("source", "id", word_count(F.col("text")).cast("bigint").alias("n")), "stats")


def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, source, tokens, mask, n`` of the documents; nothing is supervised, so the mask is null."""
    return docs(spark, sf_dir).select(
        "id", "source", words(F.col("text")).alias("tokens"), F.lit(None).cast("array<tinyint>").alias("mask")
    ).withColumn("n", F.size("tokens"))


def half_mix(stats: DataFrame) -> DataFrame:
    """Mix that allocates half of every source's tokens."""
    return stats.groupBy("source").agg(F.floor(F.sum("n") / 2).alias("allocated"))


def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def chat_mode(key: str = "conv_id"):
    """A reasoning mode per conversation: think, nothink or none (null)."""
    share = key_fraction(order_key("mode", key))
    return F.when(share < 0.4, F.lit("think")).when(share < 0.8, F.lit("nothink"))


def chat_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations rendered to ``conv_id, text`` with their reasoning header."""
    return render(chats(spark, sf_dir).withColumn("m", chat_mode()), F.col("m"), ["m"]).drop("m")


def chat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows of the rendered conversations: ``id, tokens, mask, n``."""
    return masked_rows(chat_texts(spark, sf_dir), "conv_id")


# ---- shared SQL ------------------------------------------------------------------------------------------------

# Documents with their token count.
D = r"d AS (SELECT doc_id AS id, source, lang, text, len(regexp_extract_all(text, '\S+')) AS n FROM documents)"
# Half of every source's tokens.
MIX = "mix AS (SELECT source, CAST(floor(sum(n) / 2) AS BIGINT) AS allocated FROM d GROUP BY source)"


def md5_sql(seed, *cols: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {', '.join(cols)}))"


def frac_sql(key: str) -> str:
    return f"(CAST('0x' || substr({key}, 1, 13) AS BIGINT) / 4503599627370496.0)"


def bucket_sql(key: str, n) -> str:
    return f"(CAST('0x' || substr({key}, 1, 8) AS BIGINT) % {n})"


# Token rows of the rendered conversations, built turn by turn.
CHAT = rf"""modes AS (
  SELECT conv_id, {frac_sql(md5_sql('mode', 'conv_id'))} AS f FROM (SELECT DISTINCT conv_id FROM conversations)),
headed AS (
  SELECT conv_id, turn, role, text FROM conversations
  UNION ALL
  SELECT conv_id, -1, 'system', CASE WHEN f < 0.4 THEN 'Reasoning: /think' ELSE 'Reasoning: /nothink' END
  FROM modes WHERE f < 0.8),
pieces AS (
  SELECT conv_id, turn, role, regexp_extract_all(text, '\S+') AS w FROM headed),
marked AS (
  SELECT conv_id, turn,
         list_concat(['{M.START_HEADER}', role, '{M.END_HEADER}'], w, ['{M.END_TURN}']) AS toks,
         list_concat([0, 0, 0], list_transform(range(len(w) + 1), lambda i: CASE WHEN role = 'assistant' THEN 1 ELSE 0 END)) AS ms
  FROM pieces),
c AS (
  SELECT conv_id AS id,
         list_concat(['{M.BEGIN_TEXT}'], flatten(list(toks ORDER BY turn)), ['{M.END_TEXT}']) AS tokens,
         list_concat([0], flatten(list(ms ORDER BY turn)), [0]) AS mask
  FROM marked GROUP BY conv_id)"""
# One row per token of them.
CTOK = CHAT + """,
t AS (SELECT id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token, unnest(mask) AS m FROM c)"""
# Spans of supervised tokens, end exclusive, numbered from 0.
CSPAN = CTOK + """,
sp AS (
  SELECT id, row_number() OVER (PARTITION BY id ORDER BY min(pos)) - 1 AS k, min(pos) AS s, max(pos) + 1 AS e
  FROM (SELECT id, pos, pos - row_number() OVER (PARTITION BY id ORDER BY pos) AS isl FROM t WHERE m = 1)
  GROUP BY id, isl)"""
