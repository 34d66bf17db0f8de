"""Dataset comparison and contamination with evaluation problems."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count, words
from ..operators import aggregates as A
from ..operators import compare as C
from ..operators import contamination as N
from ..operators import joins as J
from ..operators import sets as X
from ..operators import token_rows as T
from ..session import settle
from .registry import CHAT, CTOK, chat_mode, chat_rows, chats, doc_tokens, docs, query, table

MODE = "CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END"


def with_mode(rows):
    return rows.withColumn("mode", F.coalesce(chat_mode("id"), F.lit("none")))


def partly_supervised(spark, sf):
    """Rows of the conversations; those whose id ends in 0 or 5 have no supervised token."""
    none = F.transform("mask", lambda m: F.lit(0).cast("tinyint"))
    return chat_rows(spark, sf).withColumn("mask", F.when(F.col("id") % 5 == 0, none).otherwise(F.col("mask")))


@query(
    "mode_crosstab",
    f"""WITH {CTOK},
tm AS (SELECT id, pos, token, CASE WHEN id % 5 = 0 THEN 0 ELSE m END AS m FROM t),
e AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY id ORDER BY pos), 0) AS pm FROM tm),
s AS (SELECT id, count(*) AS n, sum(m) AS sup, count(*) FILTER (m = 1 AND pm = 0) AS turns,
             bool_or(pos < 400 AND token = 'the') AS terminal FROM e GROUP BY id),
x AS (SELECT s.*, {MODE} AS mode FROM s JOIN modes ON s.id = modes.conv_id)
SELECT coalesce(mode, 'ALL') AS mode, coalesce(CAST(terminal AS VARCHAR), 'ALL') AS terminal, count(*) AS n_rows,
       CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(sup) AS BIGINT) AS supervised, CAST(sum(CASE WHEN sup > 0 THEN n - sup ELSE 0 END) AS BIGINT) AS prompt_tokens,
       CAST(sum(CASE WHEN sup > 0 THEN turns ELSE 0 END) AS BIGINT) AS turns, count(*) FILTER (sup > 0 AND n >= 200) AS window_rows, count(*) FILTER (sup = 0) AS empty_rows
FROM x GROUP BY CUBE (mode, terminal)""",
)
def mode_crosstab(spark, sf):
    """The word 'the' in the opening stands for the terminal agent's phrase; every fifth row has nothing supervised."""
    marked = with_mode(partly_supervised(spark, sf)).withColumn("terminal", T.says_early("the"))
    out = A.mode_crosstab(T.row_stats(marked), 200)
    return out.withColumn("mode", F.coalesce("mode", F.lit("ALL"))).withColumn(
        "terminal", F.coalesce(F.col("terminal").cast("string"), F.lit("ALL"))
    )


# Assistant turns open a block at their first token when the conversation thinks; here the header markers bracket it.
@query(
    "think_stats",
    f"""WITH {CTOK},
tm AS (SELECT id, pos, token, CASE WHEN id % 5 = 0 THEN 0 ELSE m END AS m FROM t),
x AS (SELECT tm.*, {MODE} AS mode FROM tm JOIN modes ON tm.id = modes.conv_id WHERE id IN (SELECT id FROM tm WHERE m = 1)),
dd AS (SELECT *, sum(CASE token WHEN 'user' THEN 1 WHEN 'assistant' THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS depth FROM x),
r AS (SELECT id, mode, min(pos) FILTER (token = 'user') AS open_at, count(*) FILTER (depth > 0 AND m = 1) AS inside,
             arg_max(depth, pos) AS last_depth, count(*) AS n FROM dd GROUP BY id, mode),
k AS (SELECT r.id, min(pos) AS close_at FROM dd JOIN r USING (id) WHERE token = 'assistant' AND pos >= open_at GROUP BY r.id)
SELECT mode, count(*) AS think_rows, CAST(sum(inside) AS BIGINT) AS think_tokens, count(*) FILTER (last_depth > 0) AS unclosed,
       CAST(sum(coalesce(close_at - open_at, n - open_at)) AS BIGINT) AS first_block_tokens
FROM r LEFT JOIN k USING (id) WHERE open_at IS NOT NULL GROUP BY mode""",
)
def think_stats(spark, sf):
    """The role words stand for the block markers: user opens, assistant closes; every fifth row has nothing supervised."""
    return C.think_stats(with_mode(partly_supervised(spark, sf)), ["mode"], "user", "assistant")


CLASS = r"""CASE WHEN regexp_full_match(token, '<\|.*\|>') THEN 'special'
  WHEN regexp_matches(token, '[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7A3}]') THEN 'cjk'
  WHEN regexp_matches(token, '[^\x00-\x7f]') THEN 'other_non_ascii'
  WHEN regexp_full_match(token, '\s*\d+\s*') THEN 'digits'
  WHEN regexp_full_match(token, '\s*') THEN 'whitespace'
  WHEN regexp_matches(token, '[\\{}^_$]') THEN 'latex_code'
  WHEN regexp_matches(token, '[A-Za-z]') AND NOT regexp_matches(token, '\d') THEN 'english'
  WHEN regexp_matches(token, '[A-Za-z0-9]') THEN 'mixed' ELSE 'punctuation' END"""
DTOK = r"dt AS (SELECT doc_id AS id, source, lang, unnest(regexp_extract_all(text, '\S+')) AS token FROM documents)"


def doc_freq(spark, sf, by=()):
    return docs(spark, sf).select(*by, F.explode(words(F.col("text"))).alias("token")).groupBy(*by, "token").agg(
        F.count("*").alias("cnt")
    )


@query("token_classes", f"""WITH {DTOK} SELECT DISTINCT token, {CLASS} AS "class" FROM dt""")
def token_classes(spark, sf):
    return C.token_classes(doc_freq(spark, sf).select("token"))


@query(
    "class_hist",
    f"""WITH {DTOK}, h AS (SELECT lang, {CLASS} AS "class", count(*) AS cnt FROM dt GROUP BY 1, 2)
SELECT lang, "class", cnt, cnt / sum(cnt) OVER (PARTITION BY lang) AS share FROM h""",
)
def class_hist(spark, sf):
    return C.class_hist(doc_freq(spark, sf, ["lang"]), ["lang"])


LANGS = ["de", "en", "es", "fr"]
# One vocabulary per language: its 200 most frequent tokens.
VOCABS = f"""{DTOK},
lf AS (SELECT lang, token, count(*) AS cnt FROM dt GROUP BY 1, 2),
vocabs AS (SELECT lang AS vocab, token FROM lf QUALIFY row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, token) <= 200),
freq AS (SELECT token, CAST(sum(cnt) AS BIGINT) AS cnt FROM lf GROUP BY token)"""


def vocabs_of(spark, sf):
    from ..operators.ordering import per_group_limit

    by_lang = settle(doc_freq(spark, sf, ["lang"]), "freq")
    vocabs = per_group_limit(by_lang, ["lang"], [F.desc("cnt"), F.col("token")], 200).select(
        F.col("lang").alias("vocab"), "token"
    )
    return by_lang, vocabs


@query(
    "vocab_coverage",
    f"""WITH {VOCABS}
SELECT vocab, (SELECT CAST(sum(cnt) AS BIGINT) FROM freq) AS tokens, CAST(sum(cnt) AS BIGINT) AS covered,
       sum(cnt) / (SELECT sum(cnt) FROM freq) AS coverage FROM vocabs JOIN freq USING (token) GROUP BY vocab""",
)
def vocab_coverage(spark, sf):
    by_lang, vocabs = vocabs_of(spark, sf)
    freq = by_lang.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return C.vocab_coverage(freq, vocabs)


@query(
    "uncovered_classes",
    f"""WITH {VOCABS}, ls AS (SELECT DISTINCT vocab FROM vocabs)
SELECT vocab, {CLASS} AS "class", CAST(sum(cnt) AS BIGINT) AS cnt FROM freq, ls
WHERE NOT EXISTS (SELECT 1 FROM vocabs v WHERE v.vocab = ls.vocab AND v.token = freq.token) GROUP BY 1, 2""",
)
def uncovered_classes(spark, sf):
    by_lang, vocabs = vocabs_of(spark, sf)
    freq = by_lang.groupBy("token").agg(F.sum("cnt").alias("cnt"))
    return C.uncovered_classes(freq, vocabs)


@query(
    "top_uncovered",
    f"""WITH {VOCABS}, ls AS (SELECT DISTINCT vocab FROM vocabs),
ms AS (SELECT lf.lang, vocab, token, cnt FROM lf, ls WHERE NOT EXISTS (SELECT 1 FROM vocabs v WHERE v.vocab = ls.vocab AND v.token = lf.token))
SELECT lang, vocab, token, cnt, row_number() OVER (PARTITION BY lang, vocab ORDER BY cnt DESC, token) AS rank FROM ms QUALIFY rank <= 12""",
)
def top_uncovered(spark, sf):
    by_lang, vocabs = vocabs_of(spark, sf)
    return C.top_uncovered(by_lang, vocabs, 12, ["lang"])


@query(
    "in_vocab",
    f"""WITH {VOCABS} SELECT source, count(*) FILTER (token IN (SELECT token FROM vocabs WHERE vocab = 'en')) AS known, count(*) AS tokens
FROM dt GROUP BY source""",
)
def in_vocab(spark, sf):
    _, vocabs = vocabs_of(spark, sf)
    freq = doc_freq(spark, sf, ["source"])
    flagged = J.in_vocab(freq, vocabs.filter("vocab = 'en'"))
    return flagged.groupBy("source").agg(
        F.sum(F.when(F.col("known"), F.col("cnt")).otherwise(0)).alias("known"), F.sum("cnt").alias("tokens")
    )


@query(
    "cross_entropy",
    rf"""WITH {DTOK},
mf AS (SELECT lang AS model, token, count(*) AS cnt FROM dt GROUP BY 1, 2),
ef AS (SELECT role AS eval_set, token, count(*) AS cnt FROM (SELECT role, unnest(regexp_extract_all(text, '\S+')) AS token FROM conversations) GROUP BY 1, 2),
es AS (SELECT eval_set, sum(cnt) AS a FROM ef GROUP BY 1), msum AS (SELECT model, sum(cnt) AS n FROM mf GROUP BY 1)
SELECT eval_set, msum.model, round(sum(-(ef.cnt / a) * log2((coalesce(mf.cnt, 0) + 0.5) / (n + 0.5 * 128256))), 6) AS bits
FROM ef JOIN es USING (eval_set), msum LEFT JOIN mf ON mf.model = msum.model AND mf.token = ef.token GROUP BY 1, 2""",
)
def cross_entropy(spark, sf):
    model = doc_freq(spark, sf, ["lang"]).withColumnRenamed("lang", "model")
    model = settle(model, "models")
    evals = chats(spark, sf).select(F.col("role").alias("eval_set"), F.explode(words(F.col("text"))).alias("token"))
    out = C.cross_entropy(evals.groupBy("eval_set", "token").agg(F.count("*").alias("cnt")), model, 128256)
    return out.withColumn("bits", F.round("bits", 6))


@query(
    "marker_rates",
    r"""WITH r AS (SELECT role, 'Wait, ' || text || ' Let me see. But wait' AS text FROM conversations),
x AS (SELECT role, text, len(regexp_extract_all(text, '\S+')) AS n FROM r)
SELECT role, CAST(sum(n) AS BIGINT) AS tokens,
 sum(len(regexp_extract_all(text, '\bWait\b'))) * 1000.0::DOUBLE / sum(n) AS wait, sum(len(regexp_extract_all(text, '\bHmm\b'))) * 1000.0::DOUBLE / sum(n) AS hmm,
 sum(len(regexp_extract_all(text, '\bAlternatively\b'))) * 1000.0::DOUBLE / sum(n) AS alternatively,
 sum(len(regexp_extract_all(text, '\bBut wait\b'))) * 1000.0::DOUBLE / sum(n) AS but_wait, sum(len(regexp_extract_all(text, '\bLet me\b'))) * 1000.0::DOUBLE / sum(n) AS let_me,
 sum(len(regexp_extract_all(text, '\bActually\b'))) * 1000.0::DOUBLE / sum(n) AS actually, sum(len(regexp_extract_all(text, '\bOkay\b'))) * 1000.0::DOUBLE / sum(n) AS okay
FROM x GROUP BY role""",
)
def marker_rates(spark, sf):
    text = F.concat(F.lit("Wait, "), F.col("text"), F.lit(" Let me see. But wait"))
    rows = chats(spark, sf).withColumn("text", text).withColumn("n", word_count(F.col("text")))
    return A.marker_rates(rows, ["role"])


@query(
    "prompt_features",
    r"""SELECT lang, count(*) AS n_rows, count(*) FILTER (contains(text, 'boxed')) / count(*) AS boxed,
 count(*) FILTER (contains(lower(text), 'step by step') OR contains(lower(text), 'step-by-step')) / count(*) AS step_by_step,
 count(*) FILTER (contains(text, '```')) / count(*) AS fence,
 count(*) FILTER (contains(text, '$') OR contains(text, '\(') OR contains(text, '\[')) / count(*) AS latex,
 count(*) FILTER (length(text) > 0 AND (length(text) - length(regexp_replace(text, '[^\x00-\x7f]', '', 'g'))) / length(text) > 0.3) / count(*) AS non_ascii
FROM documents GROUP BY lang""",
)
def prompt_features(spark, sf):
    return A.prompt_features(docs(spark, sf), ["lang"])


# ---- repetition ------------------------------------------------------------------------------------------------

# Every conversation told twice, its tokens, and the 8-grams that occurred earlier in it.
GRAM8 = CHAT + """,
c2 AS (SELECT id, list_concat(tokens, tokens) AS tokens, list_concat(mask, mask) AS mask FROM c),
t AS (SELECT id, unnest(range(len(tokens))) AS pos, unnest(tokens) AS token, unnest(mask) AS m FROM c2),
g8 AS (SELECT id, unnest(range(len(tokens) - 7)) AS pos, tokens, mask FROM c2 WHERE len(tokens) >= 8),
gr AS (SELECT id, pos, array_to_string(tokens[pos + 1:pos + 8], ' ') AS gram, mask FROM g8),
fi AS (SELECT id, pos, min(pos) OVER (PARTITION BY id, gram) AS first_, mask FROM gr),
rep AS (SELECT id, pos, first_ AS first, mask[first_ + 8] = 1 AS from_reply FROM fi WHERE pos > first_)"""


def echoing_rows(spark, sf):
    """Token rows in which every conversation is told twice, so replies repeat earlier text."""
    rows = chat_rows(spark, sf)
    return rows.select(
        "id",
        F.concat("tokens", "tokens").alias("tokens"),
        F.concat("mask", "mask").alias("mask"),
        (F.col("n") * 2).alias("n"),
    )


@query("repeated_ngrams", f"WITH {GRAM8} SELECT id, pos, first, from_reply FROM rep")
def repeated_ngrams(spark, sf):
    return C.repeated_ngrams(echoing_rows(spark, sf)).withColumn("pos", F.col("pos").cast("bigint"))


@query(
    "copy_shares",
    f"""WITH {GRAM8},
cov AS (SELECT id, pos + o AS pos, bool_or(NOT from_reply) AS ctx FROM rep, range(8) r(o) GROUP BY 1, 2),
x AS (SELECT t.id, t.m, cov.ctx FROM t LEFT JOIN cov ON cov.id = t.id AND cov.pos = t.pos)
SELECT {MODE} AS mode, CAST(sum(m) AS BIGINT) AS supervised, count(*) FILTER (m = 1 AND ctx) AS from_context,
       count(*) FILTER (m = 1 AND NOT ctx) AS from_reply FROM x JOIN modes ON modes.conv_id = x.id GROUP BY 1""",
)
def copy_shares(spark, sf):
    return C.copy_shares(with_mode(echoing_rows(spark, sf)), ["mode"])


# ---- contamination ---------------------------------------------------------------------------------------------

HITS = r"""p AS (SELECT item_id, regexp_extract_all(text, '\S+') AS t FROM benchmark),
pg AS (SELECT DISTINCT item_id, array_to_string(t[i + 1:i + 13], ' ') AS gram FROM (SELECT item_id, t, unnest(range(len(t) - 12)) AS i FROM p WHERE len(t) >= 30)),
totals AS (SELECT item_id, count(*) AS total FROM pg GROUP BY 1),
own AS (SELECT gram, min(item_id) AS item_id FROM pg GROUP BY gram),
w AS (SELECT doc_id AS id, regexp_extract_all(text, '\S+') AS t FROM documents),
dg AS (SELECT DISTINCT id, array_to_string(t[i + 1:i + 13], ' ') AS gram FROM (SELECT id, t, unnest(range(len(t) - 12)) AS i FROM w WHERE len(t) >= 13)),
hits AS (SELECT id, item_id, count(*) AS found FROM dg JOIN own USING (gram) GROUP BY 1, 2),
cov AS (SELECT hits.*, total, found / total AS coverage FROM hits JOIN totals USING (item_id))"""


def problems(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", words(F.col("text")).alias("tokens"))


def summary_of(spark, sf, n=N.GRAM):
    probs = problems(spark, sf)
    hits = N.ngram_hits(doc_tokens(spark, sf), probs, n)
    return N.contamination(hits, N.problem_totals(N.problem_grams(probs, n)))


@query("ngram_hits", f"WITH {HITS} SELECT id, item_id, found, total, coverage FROM cov")
def ngram_hits(spark, sf):
    return N.ngram_hits(doc_tokens(spark, sf), problems(spark, sf))


SUMMARY = """su AS (SELECT item_id, total, coalesce(max(coverage), 0.0) AS best, arg_min(id, (-coverage, id)) AS best_row,
 count(*) FILTER (coverage >= 0.5) AS n50, count(*) FILTER (coverage >= 0.9) AS n90
FROM (SELECT totals.item_id, totals.total, id, coverage FROM totals LEFT JOIN cov USING (item_id)) GROUP BY 1, 2)"""


@query(
    "contamination",
    f"WITH {HITS}, {SUMMARY} SELECT item_id, total, best, coalesce(best_row, -1) AS best_row, n50, n90 FROM su",
)
def contamination(spark, sf):
    return summary_of(spark, sf).withColumn("best_row", F.coalesce("best_row", F.lit(-1)))


@query(
    "drop_flagged",
    f"WITH {HITS}, {SUMMARY} SELECT item_id, md5(text) AS text_md5 FROM benchmark WHERE item_id NOT IN (SELECT item_id FROM su WHERE best >= 0.5)",
)
def drop_flagged(spark, sf):
    flagged = N.flagged_items(summary_of(spark, sf))
    return J.drop_flagged(table(spark, sf, "benchmark"), flagged, ["item_id"]).select("item_id", F.md5("text").alias("text_md5"))


@query(
    "chat_contamination",
    f"""WITH {CTOK},
tg AS (SELECT id, pos, array_to_string(list(token) OVER w, ' ') AS gram, sum(m) OVER w AS sup, count(*) OVER w AS n FROM t
       WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
pt AS (SELECT conv_id AS item_id, regexp_extract_all(text, '\\S+') AS w FROM conversations WHERE turn = 0 AND role = 'user'),
pg AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 6], ' ') AS gram FROM (SELECT item_id, w, unnest(range(len(w) - 5)) AS i FROM pt WHERE len(w) >= 30)),
totals AS (SELECT item_id, count(*) AS total FROM pg GROUP BY 1),
own AS (SELECT gram, min(item_id) AS item_id FROM pg GROUP BY gram),
hits AS (SELECT id, item_id, count(DISTINCT gram) AS found FROM tg JOIN own USING (gram) WHERE n = 6 AND sup = 0 GROUP BY 1, 2)
SELECT id, item_id, found, total, found / total AS coverage FROM hits JOIN totals USING (item_id)""",
)
def chat_contamination(spark, sf):
    """Masked rows: only windows without supervised tokens count. First user texts stand for the problems, with 6-grams."""
    probs = chats(spark, sf).filter("turn = 0 AND role = 'user'").select(
        F.col("conv_id").alias("item_id"), words(F.col("text")).alias("tokens")
    )
    return N.ngram_hits(chat_rows(spark, sf), probs, 6)


@query(
    "max_over_scans",
    f"""WITH {HITS}, {SUMMARY}
SELECT item_id, greatest(best, least(total, 20) / 40) AS best FROM su""",
)
def max_over_scans(spark, sf):
    first = settle(summary_of(spark, sf), "summary")
    second = first.select("item_id", (F.least("total", F.lit(20)) / 40).alias("best"))
    return X.max_over_scans(first, second)


