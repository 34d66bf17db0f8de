"""Embeddings, nearest neighbours and selection under a token budget."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import selection as S
from ..operators import similarity as K
from ..session import settle
from .registry import SEED, D, bucket_sql, doc_stats, docs, md5_sql, query, table

DIM = 64


def vectors_sql(name: str, rows: str, key: str) -> str:
    return rf"""{name}w AS (SELECT {key} AS id, unnest(regexp_extract_all(text, '\S+')) AS t FROM {rows}),
{name}s AS (SELECT id, {bucket_sql('md5(t)', DIM)} AS slot, count(*) AS c FROM {name}w GROUP BY 1, 2),
{name} AS (SELECT id, slot, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}s)"""


VECS = f"{vectors_sql('dv', 'documents', 'doc_id')}, {vectors_sql('qv', 'benchmark', 'item_id')}"
TOP = 6
KNN = f"""{VECS},
sc AS (SELECT qv.id AS query, dv.id, round(sum(qv.x * dv.x), 12) AS score FROM qv JOIN dv USING (slot) GROUP BY 1, 2),
knn AS (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM sc QUALIFY rank <= {TOP})"""


@query("embed", f"WITH {vectors_sql('dv', 'documents', 'doc_id')} SELECT id, slot, round(x, 9) AS x FROM dv")
def embed(spark, sf):
    vecs = K.embed(docs(spark, sf), "id", dim=DIM)
    parts = vecs.select("id", F.posexplode("vec").alias("slot", "x")).filter("x > 0")
    return parts.select("id", F.col("slot").cast("bigint").alias("slot"), F.round("x", 9).alias("x"))


def near(spark, sf):
    problems = table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")
    return K.knn_topk(K.embed(problems, "query", dim=DIM), K.embed(docs(spark, sf), "id", dim=DIM), TOP)


@query("knn_topk", f"WITH {KNN} SELECT query, rank, id, round(score, 6) AS score FROM knn")
def knn_topk(spark, sf):
    """The nearest documents of every evaluation problem."""
    return near(spark, sf).withColumn("score", F.round("score", 6))


@query(
    "knn_join",
    """WITH e AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
u AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e),
p AS (SELECT label, i, avg(v[i + 1]) AS x FROM u, range(64) t(i) GROUP BY 1, 2),
q AS (SELECT label AS query, list(x ORDER BY i) AS m FROM p GROUP BY 1),
s AS (SELECT query, id, u.label, round(list_sum(list_transform(range(64), lambda i: m[i + 1] * u.v[i + 1])) / sqrt(list_sum(list_transform(m, lambda y: y * y))), 12) AS score FROM q, u)
SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank, id, label, round(score, 6) AS score FROM s QUALIFY rank <= 8""",
)
def knn_join(spark, sf):
    """The vectors nearest to the centre of every label, with their own labels."""
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", K.unit(F.col("embedding")).alias("vec"))
    centres = K.label_centroids(rows, "vec")
    out = K.knn_join(centres, rows, 8, rows.select("id", "label"))
    return out.select("query", "rank", "id", "label", F.round("score", 6).alias("score"))


BUDGET = f"""{D}, {KNN},
kn AS (SELECT knn.*, n FROM knn JOIN d USING (id)),
bd AS (SELECT CAST(floor(sum(n) * 0.6) AS BIGINT) AS budget FROM kn),
rt AS (SELECT rank, sum(sum(n)) OVER (ORDER BY rank) AS e FROM kn GROUP BY rank),
full_ AS (SELECT coalesce(max(rank), 0) AS r, coalesce(max(e), 0) AS spent FROM rt, bd WHERE e <= budget),
cand AS (SELECT kn.*, row_number() OVER (ORDER BY {md5_sql(SEED, 'rank', 'query')}, query) AS o FROM kn, full_ WHERE rank = r + 1),
walk AS (
  SELECT o, query, id, n <= (SELECT budget FROM bd) - (SELECT spent FROM full_) AS take,
         (SELECT budget FROM bd) - (SELECT spent FROM full_) - CASE WHEN n <= (SELECT budget FROM bd) - (SELECT spent FROM full_) THEN n ELSE 0 END AS room
  FROM cand WHERE o = 1
  UNION ALL
  SELECT c.o, c.query, c.id, c.n <= walk.room, walk.room - CASE WHEN c.n <= walk.room THEN c.n ELSE 0 END
  FROM walk JOIN cand c ON c.o = walk.o + 1),
taken AS (
  SELECT rank AS round, query, rank, id, score, n FROM kn, full_ WHERE rank <= r
  UNION ALL SELECT c.rank, c.query, c.rank, c.id, c.score, c.n FROM cand c JOIN walk USING (o) WHERE take)"""


def taken(spark, sf, dedup=False):
    lengths = doc_stats(spark, sf).select("id", "n")
    knn = settle(near(spark, sf), "knn")
    total = knn.join(lengths, "id").agg(F.sum("n").alias("t")).first().t
    return S.round_robin_select(knn, lengths, int(total * 0.6), SEED, dedup), lengths


@query(
    "round_robin_select",
    f"""WITH RECURSIVE {BUDGET} SELECT round, query, rank, id, round(score, 6) AS score, n FROM taken""",
)
def round_robin_select(spark, sf):
    return taken(spark, sf)[0].withColumn("score", F.round("score", 6))


def dedup_sql(budget: str) -> str:
    """Rounds unrolled: round r offers every query's nearest row that no earlier round took."""
    rounds = []
    for r in range(1, TOP + 1):
        seen = " UNION ALL ".join(f"SELECT id FROM o{i}" for i in range(1, r))
        free = f"WHERE id NOT IN ({seen})" if seen else ""
        rounds.append(f"o{r} AS (SELECT query, rank, id, score, n FROM kn {free} QUALIFY row_number() OVER (PARTITION BY query ORDER BY rank) = 1)")
    every = " UNION ALL ".join(f"SELECT {r} AS round, * FROM o{r}" for r in range(1, TOP + 1))
    return f"""WITH RECURSIVE {D}, {KNN},
kn AS (SELECT knn.*, n FROM knn JOIN d USING (id)),
bd AS ({budget}), {", ".join(rounds)},
every_ AS ({every}),
rt AS (SELECT round, sum(sum(n)) OVER (ORDER BY round) AS e FROM every_ GROUP BY round),
full_ AS (SELECT coalesce(max(round), 0) AS r, coalesce(max(e), 0) AS spent FROM rt, bd WHERE e <= budget),
cand AS (SELECT every_.*, row_number() OVER (ORDER BY {md5_sql(SEED, 'round', 'query')}, query) AS o FROM every_, full_ WHERE round = r + 1),
walk AS (
  SELECT o, n <= budget - spent AS take, budget - spent - CASE WHEN n <= budget - spent THEN n ELSE 0 END AS room
  FROM cand, bd, full_ WHERE o = 1
  UNION ALL
  SELECT c.o, c.n <= walk.room, walk.room - CASE WHEN c.n <= walk.room THEN c.n ELSE 0 END FROM walk JOIN cand c ON c.o = walk.o + 1)
SELECT round, query, rank, id, round(score, 6) AS score, n FROM every_, full_ WHERE round <= r
UNION ALL SELECT c.round, query, rank, id, round(score, 6), n FROM cand c JOIN walk USING (o) WHERE take"""


@query("round_robin_dedup", dedup_sql("SELECT CAST(floor(sum(n) * 0.6) AS BIGINT) AS budget FROM kn"))
def round_robin_dedup(spark, sf):
    return taken(spark, sf, dedup=True)[0].withColumn("score", F.round("score", 6))


def percentiles_sql(name: str, source: str) -> str:
    return ", ".join(
        f"(SELECT round(quantile_cont(n, {q / 100}), 6) FROM {source}) AS {name}_{'median' if q == 50 else f'p{q}'}" for q in A.PERCENTS
    )


@query(
    "selection_summary",
    f"""WITH RECURSIVE {BUDGET} SELECT count(*) AS selected_rows, count(DISTINCT id) AS unique_rows, count(*) - count(DISTINCT id) AS duplicate_rows,
CAST(sum(n) AS BIGINT) AS selected_tokens, {percentiles_sql('selected', 'taken')}, {percentiles_sql('universe', 'd')} FROM taken""",
)
def selection_summary(spark, sf):
    out = A.selection_summary(*taken(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c.startswith(("selected_p", "universe_p")) or c.endswith("_median")})


@query(
    "score_by_rank",
    f"WITH RECURSIVE {BUDGET} SELECT rank, count(*) AS n_rows, round(avg(score), 6) AS mean_score FROM taken GROUP BY rank",
)
def score_by_rank(spark, sf):
    return A.score_by_rank(taken(spark, sf)[0]).withColumn("mean_score", F.round("mean_score", 6))
