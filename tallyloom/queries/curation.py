"""Budgets, statistics, totals, vocabularies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import compare as C
from ..operators import selection as S
from ..operators import sets as X
from ..operators import token_rows as T
from ..operators.texts import normalize_text as normalize
from ..session import settle
from ..sources.readers import mix_from_column
from .registry import CHAT, CTOK, MIX, SEED, D, chat_mode, chat_rows, doc_stats, docs, half_mix, md5_sql, query, table

PICK = f"""o AS (
  SELECT source, id, n, sum(n) OVER (PARTITION BY source ORDER BY {md5_sql(SEED, 'source', 'id')}, id
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM d WHERE n > 0),
picked AS (
  SELECT source, id, n FROM o JOIN mix USING (source) WHERE coalesce(before, 0) < allocated)"""


def _budget(spark, sf):
    stats = doc_stats(spark, sf)
    mix = settle(half_mix(stats), "mix")
    targets = mix.withColumnRenamed("allocated", "target")
    return stats, mix, targets, S.budget_select(stats, targets, SEED)


@query("budget_select", f"WITH {D}, {MIX}, {PICK} SELECT source, id, n FROM picked")
def budget_select(spark, sf):
    return _budget(spark, sf)[3]


@query(
    "budget_report",
    f"""WITH {D}, {MIX}, {PICK},
store AS (SELECT source, sum(n) AS s FROM d WHERE n > 0 GROUP BY source),
p AS (SELECT source, count(*) AS r, sum(n) AS t FROM picked GROUP BY source)
SELECT source, allocated, allocated AS target_tokens, CAST(s AS BIGINT) AS store_tokens,
       coalesce(r, 0) AS n_rows, CAST(coalesce(t, 0) AS BIGINT) AS selected_tokens,
       CASE WHEN s IS NULL THEN 'no stats' WHEN s < allocated THEN 'below' WHEN s = allocated THEN 'exact' ELSE 'ok' END AS status
FROM mix LEFT JOIN store USING (source) LEFT JOIN p USING (source)""",
)
def budget_report(spark, sf):
    stats, mix, targets, chosen = _budget(spark, sf)
    return S.budget_report(stats, mix, targets, chosen)


@query(
    "scale_allocation",
    f"""WITH {D}, {MIX},
m AS (SELECT source, sum(n) / count(*) AS mean_n FROM d WHERE n > 0 GROUP BY source),
t AS (SELECT sum(allocated / mean_n) AS t FROM mix JOIN m USING (source))
SELECT source, allocated, round(allocated * (100.0::DOUBLE / t), 4) AS target FROM mix JOIN m USING (source), t""",
)
def scale_allocation(spark, sf):
    stats = doc_stats(spark, sf)
    return S.scale_allocation(stats, half_mix(stats), 100).withColumn("target", F.round("target", 4))


@query(
    "allocation_status",
    f"""WITH {D},
mix AS (
  SELECT source, CAST(CASE WHEN substr(source, 4)::INT % 3 = 0 THEN sum(n) + 10 WHEN substr(source, 4)::INT % 3 = 1 THEN sum(n)
         ELSE floor(sum(n) / 2) END AS BIGINT) AS allocated FROM d GROUP BY source
  UNION ALL SELECT lang || '-missing', CAST(sum(n) AS BIGINT) FROM d GROUP BY lang),
store AS (SELECT source, sum(n) AS s FROM d WHERE n > 0 GROUP BY source)
SELECT source, allocated, coalesce(CAST(s AS BIGINT), -1) AS store_tokens,
       CASE WHEN s IS NULL THEN 'no stats' WHEN s < allocated THEN 'below' WHEN s = allocated THEN 'exact' ELSE 'ok' END AS status
FROM mix LEFT JOIN store USING (source)""",
)
def allocation_status(spark, sf):
    base = docs(spark, sf)
    stats = doc_stats(spark, sf)
    third = F.substring("source", 4, 9).cast("int") % 3
    mix = stats.groupBy("source").agg(F.sum("n").alias("s")).select(
        "source",
        F.when(third == 0, F.col("s") + 10).when(third == 1, F.col("s")).otherwise(F.floor(F.col("s") / 2)).alias("allocated"),
    )
    lost = (
        base.select("id", "lang").join(stats, "id").groupBy("lang").agg(F.sum("n").alias("allocated"))
        .select(F.concat("lang", F.lit("-missing")).alias("source"), "allocated")
    )
    return S.allocation_status(mix.unionByName(lost), stats).withColumn(
        "store_tokens", F.coalesce("store_tokens", F.lit(-1))
    )


@query("load_mix", f"WITH {D}, {MIX} SELECT source, allocated FROM mix")
def load_mix(spark, sf):
    """The mix goes through its JSON form and back."""
    mix = half_mix(doc_stats(spark, sf))
    # One JSON text per language group of sources, as several specification files would be.
    spec = mix.groupBy(F.substring("source", -1, 1).alias("g")).agg(
        F.to_json(
            F.struct(F.map_from_entries(F.collect_list(F.struct("source", "allocated"))).alias("allocations_tokens"))
        ).alias("spec")
    )
    return mix_from_column(spec, "spec")


@query(
    "normalize_text",
    r"""SELECT md5(regexp_replace(text, '(\s{128})\s+', '\1', 'g')) AS text_id, doc_id AS source_id,
       length(regexp_replace(text, '(\s{128})\s+', '\1', 'g')) AS n_chars
FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -doc_id - 1, E'\n\t \n' FROM documents) WHERE regexp_matches(text, '\S')""",
)
def normalize_text(spark, sf):
    """Every document, and one of white space only beside it."""
    rows = docs(spark, sf)
    blank = rows.withColumns({"id": -F.col("id") - 1, "text": F.lit("\n\t \n")})
    return normalize(rows.unionByName(blank)).select(
        "text_id", F.col("id").alias("source_id"), F.length("text").cast("bigint").alias("n_chars")
    )


@query(
    "exact_dedup",
    """SELECT doc_id AS id, md5(text) AS text_md5 FROM documents
WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY text)""",
)
def exact_dedup(spark, sf):
    return A.exact_dedup(docs(spark, sf)).select("id", F.md5("text").alias("text_md5"))


@query(
    "distinct_sum",
    """WITH once AS (SELECT lang, text, max(n_chars) AS v FROM documents GROUP BY lang, text),
every AS (SELECT text, max(v) AS v FROM once GROUP BY text)
SELECT lang, count(*) AS n_keys, CAST(sum(v) AS BIGINT) AS total FROM once GROUP BY lang
UNION ALL SELECT 'ALL', count(*), CAST(sum(v) AS BIGINT) FROM every""",
)
def distinct_sum(spark, sf):
    base = table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("h"), "n_chars")
    return A.distinct_sum(base, "lang", "h", "n_chars").withColumn("lang", F.coalesce("lang", F.lit("ALL")))


@query(
    "duplicate_keys",
    "SELECT md5(text) AS h, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_keys(spark, sf):
    """The rows a uniqueness check would stop on."""
    return X.duplicate_keys(docs(spark, sf).select(F.md5("text").alias("h")), ["h"])


# ---- token rows ------------------------------------------------------------------------------------------------


@query(
    "encode",
    f"""WITH {CTOK},
v AS (SELECT token, row_number() OVER (ORDER BY count(*) DESC, token) - 1 + 9 AS tid FROM t
      WHERE token NOT LIKE '<%' GROUP BY token ORDER BY count(*) DESC, token LIMIT 391),
fixed AS (SELECT unnest(['<|begin_of_text|>', '<|end_of_text|>', '<|start_think|>', '<|end_think|>', '<|start_header_id|>',
                         '<|end_header_id|>', '<|eot_id|>', '<tool_call>', '<unk>']) AS token, unnest(range(9)) AS tid),
allv AS (SELECT * FROM v UNION ALL SELECT * FROM fixed)
SELECT t.id, '0,' || string_agg(CAST(coalesce(tid, 8) AS VARCHAR), ',' ORDER BY pos) || ',1' AS ids
FROM t LEFT JOIN allv USING (token) GROUP BY t.id""",
)
def encode(spark, sf):
    rows = settle(chat_rows(spark, sf).select("id", "tokens"), "rows")
    vocab = T.build_vocab(rows.select(F.explode("tokens").alias("token")), 400, RESERVED)
    ids = T.encode(rows, vocab, bos=0, eos=1, unknown=8)
    return ids.select("id", F.array_join(F.transform("input_ids", lambda i: i.cast("string")), ",").alias("ids"))


# Reserved ids 0-8 of the stand-in vocabulary; id 8 stands for unknown tokens.
RESERVED = (
    "<|begin_of_text|>", "<|end_of_text|>", "<|start_think|>", "<|end_think|>", "<|start_header_id|>",
    "<|end_header_id|>", "<|eot_id|>", "<tool_call>", "<unk>",
)


@query(
    "build_vocab",
    r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM documents),
f AS (SELECT token, count(*) AS cnt FROM t GROUP BY token)
SELECT token, row_number() OVER (ORDER BY cnt DESC, token) - 1 AS token_id FROM f ORDER BY cnt DESC, token LIMIT 1000""",
)
def build_vocab(spark, sf):
    from ..functions.text import words

    tokens = docs(spark, sf).select(F.explode(words(F.col("text"))).alias("token"))
    return T.build_vocab(tokens, 1000).withColumn("token_id", F.col("token_id").cast("bigint"))


@query(
    "assistant_mask",
    f"WITH {CHAT} SELECT id, array_to_string(mask, '') AS mask, len(tokens) AS n FROM c",
)
def assistant_mask(spark, sf):
    return chat_rows(spark, sf).select(
        "id", F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"), F.col("n").cast("bigint").alias("n")
    )


@query(
    "row_stats",
    f"""WITH {CTOK},
e AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY id ORDER BY pos), 0) AS pm FROM t)
SELECT id, count(*) AS n_tokens, CAST(sum(m) AS BIGINT) AS n_supervised,
       count(*) FILTER (m = 1 AND pm = 0) AS n_assistant,
       count(*) FILTER (token = '<|start_header_id|>') AS n_headers,
       count(*) FILTER (token = '<|start_think|>') AS n_think,
       count(*) FILTER (token = '<tool_call>') AS n_tool_calls
FROM e GROUP BY id""",
)
def row_stats(spark, sf):
    return T.row_stats(chat_rows(spark, sf))


CLIP = 120


@query(
    "source_totals",
    f"""WITH {CTOK},
r AS (SELECT id, count(*) AS n, CAST(sum(CASE WHEN pos < {CLIP} THEN m ELSE 0 END) AS BIGINT) AS sc FROM t GROUP BY id),
s AS (SELECT r.*, CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS source
      FROM r JOIN modes ON r.id = modes.conv_id)
SELECT coalesce(source, 'ALL') AS source, count(*) AS rows_in, count(*) FILTER (sc > 0) AS rows_kept,
       count(*) FILTER (n > {CLIP}) AS rows_clipped, CAST(sum(greatest(n - {CLIP}, 0)) AS BIGINT) AS tokens_clipped,
       count(*) FILTER (sc = 0) AS dropped_unsupervised,
       CAST(sum(CASE WHEN sc > 0 THEN least(n, {CLIP}) ELSE 0 END) AS BIGINT) AS tokens_kept,
       CAST(sum(sc) AS BIGINT) AS tokens_supervised
FROM s GROUP BY ROLLUP (source)""",
)
def source_totals(spark, sf):
    rows = chat_rows(spark, sf)
    stats = rows.select(
        F.coalesce(chat_mode("id"), F.lit("none")).alias("source"),
        F.col("n").alias("n_tokens"),
        T.supervised(F.slice("mask", 1, CLIP)).alias("n_supervised_clipped"),
    )
    return A.source_totals(stats, CLIP).withColumn("source", F.coalesce("source", F.lit("ALL")))


@query(
    "clip",
    f"""WITH {CHAT} SELECT id, least(len(tokens), {CLIP}) AS n, greatest(len(tokens) - {CLIP}, 0) AS clipped,
       md5(array_to_string(tokens[1:{CLIP}], ' ')) AS text_md5, CAST(list_sum(mask[1:{CLIP}]) AS BIGINT) AS n_supervised FROM c""",
)
def clip(spark, sf):
    return T.clip(chat_rows(spark, sf), CLIP).select(
        "id", "n", "clipped", F.md5(F.array_join("tokens", " ")).alias("text_md5"), T.supervised(F.col("mask")).alias("n_supervised")
    )


@query(
    "drop_unsupervised",
    f"WITH {CHAT} SELECT id, least(len(tokens), {CLIP}) AS n FROM c WHERE list_sum(mask[1:{CLIP}]) > 0",
)
def drop_unsupervised(spark, sf):
    return T.drop_unsupervised(T.clip(chat_rows(spark, sf), CLIP)).select("id", "n")


@query(
    "length_filter",
    f"""WITH {CHAT} SELECT id, len(tokens) AS n, 'keep' AS rule FROM c WHERE len(tokens) BETWEEN 50 AND 150
UNION ALL SELECT id, len(tokens), 'below' FROM c WHERE len(tokens) >= 0 AND len(tokens) < 150""",
)
def length_filter(spark, sf):
    rows = chat_rows(spark, sf).select("id", "n")
    a = T.length_filter(rows, 50, 150).withColumn("rule", F.lit("keep"))
    return a.unionByName(T.length_filter(rows, 0, 150, inclusive=False).withColumn("rule", F.lit("below")))


@query(
    "validate_rows",
    f"""WITH {CHAT} SELECT id FROM c WHERE len(tokens) > {CLIP} OR list_sum(mask) = 0""",
)
def validate_rows(spark, sf):
    """Rows that break an invariant of a finished set (here: too long, or nothing supervised)."""
    return T.bad_rows(chat_rows(spark, sf), CLIP).select("id")


@query("token_freq", f"WITH {CTOK} SELECT token, count(*) AS cnt FROM t WHERE m = 1 GROUP BY token")
def token_freq(spark, sf):
    return T.token_freq(chat_rows(spark, sf))


@query(
    "sum_freq",
    rf"""WITH {CTOK},
a AS (SELECT token, count(*) AS cnt FROM t WHERE m = 1 GROUP BY token),
b AS (SELECT token, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(text, '\S+')) AS token FROM benchmark) GROUP BY token)
SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY token""",
)
def sum_freq(spark, sf):
    from ..functions.text import words

    problems = table(spark, sf, "benchmark").select(F.explode(words(F.col("text"))).alias("token"))
    return T.sum_freq(T.token_freq(chat_rows(spark, sf)), problems.groupBy("token").agg(F.count("*").alias("cnt")))


# ---- lengths ---------------------------------------------------------------------------------------------------


@query(
    "length_quantiles",
    f"""WITH {D},
r AS (SELECT source, n, row_number() OVER (PARTITION BY source ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY source) AS c FROM d)
SELECT source, count(*) AS n_rows, round(quantile_cont(n, 0.1), 6) AS p10, round(quantile_cont(n, 0.5), 6) AS p50,
       round(quantile_cont(n, 0.9), 6) AS p90, round(quantile_cont(n, 0.99), 6) AS p99,
       max(CASE WHEN i = c // 2 THEN n END) AS median_rank, max(n) AS longest
FROM r GROUP BY source""",
)
def length_quantiles(spark, sf):
    out = A.length_quantiles(doc_stats(spark, sf), [0.1, 0.5, 0.9, 0.99], ["source"])
    for p in ("p10", "p50", "p90", "p99"):
        out = out.withColumn(p, F.round(p, 6))
    return out


@query(
    "length_hist",
    f"""WITH {D} SELECT lang, CAST(least(19, length(bin(n + 1)) - 1) AS BIGINT) AS bucket, count(*) AS n_rows FROM d GROUP BY 1, 2""",
)
def length_hist(spark, sf):
    from ..functions.text import word_count

    lengths = docs(spark, sf).select("lang", word_count(F.col("text")).alias("n"))
    return A.length_hist(lengths, ["lang"]).withColumn("bucket", F.col("bucket").cast("bigint"))


@query(
    "length_bands",
    f"""WITH {D},
b AS (SELECT lang, CASE WHEN n >= 1024 THEN 1024 WHEN n >= 256 THEN 256 WHEN n >= 64 THEN 64 ELSE 0 END AS band, count(*) AS n_rows
      FROM d GROUP BY 1, 2)
SELECT lang, band, n_rows, n_rows / sum(n_rows) OVER (PARTITION BY lang) AS share FROM b""",
)
def length_bands(spark, sf):
    from ..functions.text import word_count

    lengths = docs(spark, sf).select("lang", word_count(F.col("text")).alias("n"))
    return A.length_bands(lengths, [0, 64, 256, 1024], ["lang"])


@query(
    "threshold_table",
    f"""WITH {D}, th AS (SELECT unnest([64, 256, 1024, 4096]) AS threshold)
SELECT threshold, count(*) FILTER (n >= threshold) AS rows_at, count(*) FILTER (n >= threshold) / count(*) AS share,
       CAST(sum(CASE WHEN n >= threshold THEN n ELSE 0 END) AS BIGINT) AS tokens_at FROM d, th GROUP BY threshold""",
)
def threshold_table(spark, sf):
    from ..functions.text import word_count

    return A.threshold_table(docs(spark, sf).select(word_count(F.col("text")).alias("n")), [64, 256, 1024, 4096])


@query(
    "clip_keep_rate",
    f"""WITH {D}, cl AS (SELECT unnest([128, 512, 2048, 8192]) AS clip)
SELECT clip, CAST(sum(least(n, clip)) AS BIGINT) AS tokens_kept, sum(least(n, clip)) / sum(n) AS keep_rate FROM d, cl GROUP BY clip""",
)
def clip_keep_rate(spark, sf):
    from ..functions.text import word_count

    return A.clip_keep_rate(docs(spark, sf).select(word_count(F.col("text")).alias("n")), [128, 512, 2048, 8192])


# ---- vocabularies ----------------------------------------------------------------------------------------------


@query(
    "draft_vocab",
    """WITH f AS (SELECT l_partkey AS token, count(*) AS cnt FROM lineitem GROUP BY 1),
top AS (SELECT token FROM f ORDER BY cnt DESC, token LIMIT 1500)
SELECT row_number() OVER (ORDER BY token) - 1 AS draft_idx, token, token - (row_number() OVER (ORDER BY token) - 1) AS d2t
FROM (SELECT token, 0 AS pad FROM top UNION ALL
      SELECT range, 1 FROM range(30000) WHERE range NOT IN (SELECT token FROM top) ORDER BY 2, 1 LIMIT 1500)""",
)
def draft_vocab(spark, sf):
    """Part keys stand for token ids."""
    freq = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("token")).agg(F.count("*").alias("cnt"))
    return C.draft_vocab(freq, 1500, 30000)


@query(
    "draft_vocab_padded",
    """WITH f AS (SELECT s_suppkey * 3 AS token, count(*) AS cnt FROM supplier GROUP BY 1),
pool AS (SELECT token, 0 AS pad, cnt FROM f UNION ALL SELECT range, 1, 0 FROM range(200000) WHERE range NOT IN (SELECT token FROM f)),
pick AS (SELECT token FROM pool ORDER BY pad, CASE WHEN pad = 0 THEN -cnt ELSE 0 END, token LIMIT 4000)
SELECT row_number() OVER (ORDER BY token) - 1 AS draft_idx, token, token - (row_number() OVER (ORDER BY token) - 1) AS d2t FROM pick""",
)
def draft_vocab_padded(spark, sf):
    """Fewer distinct ids than the size: padded with the lowest unused ids."""
    freq = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") * 3).alias("token")).agg(F.count("*").alias("cnt"))
    return C.draft_vocab(freq, 4000, 200000)


@query(
    "draft_vocab_frozen",
    """WITH f AS (SELECT l_partkey AS token, count(*) AS cnt FROM lineitem GROUP BY 1),
g AS (SELECT l_partkey AS token, count(*) AS cnt FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1),
ftop AS (SELECT token FROM f ORDER BY cnt DESC, token LIMIT 1000),
gtop AS (SELECT token FROM g ORDER BY cnt DESC, token LIMIT 1000),
own AS (SELECT token FROM (SELECT token, 0 AS pad FROM ftop UNION ALL
        SELECT range, 1 FROM range(30000) WHERE range NOT IN (SELECT token FROM ftop)) ORDER BY pad, token LIMIT 1000),
frozen AS (SELECT token FROM (SELECT token, 0 AS pad FROM gtop UNION ALL
        SELECT range, 1 FROM range(30000) WHERE range NOT IN (SELECT token FROM gtop)) ORDER BY pad, token LIMIT 1000)
SELECT count(*) FILTER (token IN (SELECT token FROM frozen)) AS shared,
       count(*) FILTER (token NOT IN (SELECT token FROM frozen)) AS differing FROM own""",
)
def draft_vocab_frozen(spark, sf):
    """How a vocabulary built now differs from a frozen one."""
    lines = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("token"), "l_returnflag")
    own = C.draft_vocab(lines.groupBy("token").agg(F.count("*").alias("cnt")), 1000, 30000)
    old = lines.filter("l_returnflag = 'R'").groupBy("token").agg(F.count("*").alias("cnt"))
    return C.vocab_difference(own, C.draft_vocab(old, 1000, 30000))


@query(
    "status_counts",
    f"""WITH {D} SELECT source, CASE WHEN n = 0 THEN 'empty' WHEN n > 1000 THEN 'too_long' WHEN n < 20 THEN 'too_short' ELSE 'kept' END AS status,
count(*) AS n_rows FROM d GROUP BY 1, 2""",
)
def status_counts(spark, sf):
    n = F.col("n")
    status = F.when(n == 0, F.lit("empty")).when(n > 1000, F.lit("too_long")).when(n < 20, F.lit("too_short")).otherwise(F.lit("kept"))
    return A.status_counts(doc_stats(spark, sf).withColumn("status", status), ["source"])


