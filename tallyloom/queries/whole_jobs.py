"""The composed jobs, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markers as M
from ..functions.seeded import key_bucket
from ..functions.text import marked_tokens
from ..operators import token_rows as T
from ..plans import curation, decontaminate, regenerate, similar_rows
from ..session import fresh_path, settle

from .comparing import HITS, SUMMARY, problems
from .similar import dedup_sql
from .registry import CHAT, SEED, bucket_sql, chat_mode, chat_rows, chat_texts, doc_tokens, docs, md5_sql, query, table

LENGTH = 150
SHARD = 8000


@query(
    "curate",
    f"""WITH {CHAT},
d AS (SELECT id, CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS source, len(tokens) AS n,
      list_sum(mask[1:{LENGTH}]) AS sup FROM c JOIN modes ON conv_id = id),
mix AS (SELECT source, CAST(floor(sum(n) / 2) AS BIGINT) AS allocated FROM d GROUP BY source),
o AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY {md5_sql(SEED, 'source', 'id')}, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d),
p AS (SELECT o.* FROM o JOIN mix USING (source) WHERE coalesce(before, 0) < allocated),
k AS (SELECT CAST(ceil(sum(n) / {float(SHARD)}) AS BIGINT) AS k FROM p)
SELECT id, source, least(n, {LENGTH}) AS n, {bucket_sql('md5(CAST(id AS VARCHAR))', 'k')} AS shard FROM p, k WHERE sup > 0""",
)
def curate(spark, sf):
    """Conversations by reasoning mode, half of each mode's tokens, written and read back."""
    texts = chat_texts(spark, sf).select(
        F.col("conv_id").alias("id"), F.coalesce(chat_mode("conv_id"), F.lit("none")).alias("source"), "text"
    )
    sizes = T.tokenize(texts).groupBy("source").agg(F.floor(F.sum("n") / 2).alias("allocated"))
    path = fresh_path(spark, "curated")
    curation.curate(texts, sizes, path, LENGTH, SHARD, SEED)
    return spark.read.parquet(f"{path}/rows").select("id", "source", "n", F.col("shard").cast("int").alias("shard"))


# Ids of the stand-in tokenizer: reserved ids for the markers and roles, hashed ids for all other tokens.
RESERVED = (M.BEGIN_TEXT, M.END_TEXT, M.START_HEADER, M.END_HEADER, M.END_TURN, "assistant", "user", "system")
OTHER, KINDS = 100, 1_000_000


def hashed_ids(text):
    def one(t):
        code = F.lit(OTHER) + key_bucket(F.md5(t), KINDS)
        for i, marker in enumerate(RESERVED):
            code = F.when(t == marker, F.lit(i)).otherwise(code)
        return code.cast("int")

    return F.transform(marked_tokens(text), one)


TOKENIZER = T.IdTokenizer(hashed_ids, 2, (5,), 3, 4, newline_tokens=0)
IDS = (
    "list_transform(tokens, lambda t: CASE "
    + " ".join(f"WHEN t = '{m}' THEN {i}" for i, m in enumerate(RESERVED))
    + f" ELSE {OTHER} + {bucket_sql('md5(t)', KINDS)} END)"
)


@query(
    "id_mask",
    f"""WITH {CHAT} SELECT id, md5(array_to_string({IDS}, ',')) AS ids_md5, array_to_string(mask, '') AS mask FROM c""",
)
def id_mask(spark, sf):
    """The conversations as integer ids, masked on the ids."""
    rows = T.id_rows(chat_texts(spark, sf), TOKENIZER, "conv_id")
    return rows.select(
        "id", F.md5(F.array_join("tokens", ",")).alias("ids_md5"), F.array_join("mask", "").alias("mask")
    )


@query(
    "curate_whole",
    f"""WITH {CHAT},
d AS (SELECT id, CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS source, len(tokens) AS n,
      list_sum(mask[1:{LENGTH}]) AS sup, {IDS} AS ids, mask FROM c JOIN modes ON conv_id = id),
k AS (SELECT CAST(ceil(sum(n) / {float(SHARD)}) AS BIGINT) AS k FROM d)
SELECT id, source, md5(array_to_string(ids[1:{LENGTH}], ',')) AS ids_md5, array_to_string(mask[1:{LENGTH}], '') AS loss_mask,
       least(n, {LENGTH}) AS seq_len, {bucket_sql('md5(CAST(id AS VARCHAR))', 'k')} AS shard FROM d, k WHERE sup > 0""",
)
def curate_whole(spark, sf):
    """Whole sources as integer ids, in three jobs; allocations larger than the sources are no hindrance."""
    texts = chat_texts(spark, sf).select(
        F.col("conv_id").alias("id"), F.coalesce(chat_mode("conv_id"), F.lit("none")).alias("source"), "text"
    )
    sizes = texts.groupBy("source").agg(F.sum(F.length("text")).alias("allocated"))
    path = fresh_path(spark, "curated")
    curation.curate(texts, sizes, path, LENGTH, SHARD, SEED, whole=True, tokenizer=TOKENIZER, parts=3)
    rows = spark.read.parquet(f"{path}/rows")
    return rows.select(
        "id", "source", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"), F.array_join("loss_mask", "").alias("loss_mask"),
        F.col("seq_len").cast("bigint").alias("seq_len"), F.col("shard").cast("int").alias("shard"),
    )


@query(
    "decontaminate",
    f"WITH {HITS}, {SUMMARY} SELECT item_id, len(t) AS n FROM p WHERE item_id NOT IN (SELECT item_id FROM su WHERE best >= 0.5)",
)
def decontaminated(spark, sf):
    """Over the documents and the conversations (whose windows hold no problem)."""
    kept = decontaminate.decontaminate(
        problems(spark, sf),
        {"documents": doc_tokens(spark, sf), "conversations": chat_rows(spark, sf).withColumn("id", F.col("id").cast("bigint"))},
    )
    return kept.select("item_id", F.size("tokens").alias("n"))


@query("similar_subset", dedup_sql("SELECT CAST(floor(sum(n) * 0.01) AS BIGINT) AS budget FROM d"))
def similar_subset(spark, sf):
    """Every problem's nearest free document per round, a hundredth of all tokens."""
    from ..functions.text import word_count

    prompts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    universe = settle(
        docs(spark, sf).select("id", "text", word_count(F.col("text")).cast("bigint").alias("n")), "universe"
    )
    budget = int((universe.agg(F.sum("n").alias("t")).first().t or 0) * 0.01)
    return similar_rows.similar_subset(prompts, universe, 6, budget, SEED, dedup=True).withColumn(
        "score", F.round("score", 6)
    )


@query(
    "regenerate",
    f"""WITH {CHAT}, t AS (SELECT conv_id AS id, count(*) FILTER (role = 'assistant') AS turns,
 sum(CASE WHEN role = 'assistant' THEN 4 ELSE len(w) + 4 END) + 2 AS n FROM pieces GROUP BY 1)
SELECT id, CAST(n + turns AS BIGINT) AS n, turns AS n_regenerated, CASE WHEN turns = 0 THEN 'no_assistant_turn' ELSE 'complete' END AS status FROM t""",
)
def regenerated(spark, sf):
    """Every reply becomes one word and the end of the turn."""

    end = M.END_TURN

    def short(prompts, max_tokens, request_seeds):
        return [(["yes", end], "stop") for _ in prompts]

    parts = regenerate.regenerate(chat_rows(spark, sf), short, 1_000_000, 64, SEED)
    return parts.select("id", F.size("tokens").cast("bigint").alias("n"), "n_regenerated", "status")
