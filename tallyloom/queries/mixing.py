"""Joins by key and range, samples, splits, packing, balanced groups, mixes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J
from ..operators import selection as S
from ..operators import sets as X
from ..operators.ordering import seeded_index
from ..session import settle
from .curation import PICK, _budget
from .registry import MIX, SEED, D, bucket_sql, chats, doc_stats, docs, frac_sql, md5_sql, query, table

# ---- joins -----------------------------------------------------------------------------------------------------


@query(
    "keep_selected",
    f"WITH {D}, {MIX}, {PICK} SELECT doc_id AS id, md5(text) AS text_md5 FROM documents WHERE doc_id IN (SELECT id FROM picked)",
)
def keep_selected(spark, sf):
    chosen = _budget(spark, sf)[3]
    return J.keep_selected(docs(spark, sf), chosen).select("id", F.md5("text").alias("text_md5"))


@query(
    "exclude_keys",
    """SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (
  SELECT 1 FROM (SELECT l_orderkey AS k, max(l_linenumber) AS m FROM lineitem GROUP BY 1) h WHERE h.k = l.l_orderkey AND h.m = l.l_linenumber)""",
)
def exclude_keys(spark, sf):
    """Composite key: the last line of every order is held out."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    held = lines.groupBy("l_orderkey").agg(F.max("l_linenumber").alias("l_linenumber"))
    return J.exclude_keys(lines, held, ["l_orderkey", "l_linenumber"])


@query(
    "resume_against",
    "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def resume_against(spark, sf):
    """Labelled documents are the rows already done."""
    return J.resume_against(
        table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id"), ["doc_id"]
    )


RANGES = "rg AS (SELECT CAST(o_orderkey AS BIGINT) * 4 AS lo, CAST(o_orderkey AS BIGINT) * 4 + 1 + (o_orderkey % 3) AS hi FROM orders WHERE o_orderpriority = '1-URGENT')"


def ranges_of(spark, sf):
    key = F.col("o_orderkey") * 4
    return table(spark, sf, "orders").filter("o_orderpriority = '1-URGENT'").select(
        key.alias("lo"), (key + 1 + F.col("o_orderkey") % 3).alias("hi")
    )


@query(
    "exclude_ranges",
    f"""WITH {RANGES} SELECT l_orderkey, l_linenumber FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM rg WHERE l.l_orderkey * 4 + l.l_linenumber % 4 >= lo AND l.l_orderkey * 4 + l.l_linenumber % 4 < hi)""",
)
def exclude_ranges(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").withColumn(
        "row", F.col("l_orderkey") * 4 + F.col("l_linenumber") % 4
    )
    return J.exclude_ranges(lines, ranges_of(spark, sf), "row").drop("row")


@query(
    "locate_rows",
    """WITH s AS (SELECT source, count(*) AS c FROM documents GROUP BY source),
o AS (SELECT source AS shard, sum(c) OVER (ORDER BY source) - c AS lo, sum(c) OVER (ORDER BY source) AS hi FROM s),
i AS (SELECT event_id, event_id % (SELECT count(*) FROM documents) AS row_index FROM events)
SELECT event_id, shard, CAST(row_index - lo AS BIGINT) AS local_row FROM i JOIN o ON row_index >= lo AND row_index < hi""",
)
def locate_rows(spark, sf):
    """Event ids wrapped over the documents are the global positions; every source is a shard."""
    from pyspark.sql import Window as W

    sizes = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.orderBy("source"))
    shards = settle(sizes.select(F.col("source").alias("shard"), (upto - F.col("c")).alias("lo"), upto.alias("hi")), "shards")
    total = shards.agg(F.max("hi")).scalar()
    index = table(spark, sf, "events").select("event_id", (F.col("event_id") % total).alias("row_index"))
    return J.locate_rows(index, shards, "row_index").select("event_id", "shard", "local_row")


@query(
    "attach_source",
    "SELECT md5(d.text) AS id, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
)
def attach_source(spark, sf):
    texts = table(spark, sf, "documents").select(F.md5("text").alias("id"), F.col("doc_id").alias("source_id"))
    records = table(spark, sf, "labels").withColumnRenamed("doc_id", "source_id")
    return J.attach_source(texts, records).select("id", "quality", "toxic")


@query(
    "pair_completions",
    """SELECT a.conv_id, a.turn, length(a.text) AS prompt_chars, length(b.text) AS reply_chars FROM conversations a
JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'""",
)
def pair_completions(spark, sf):
    turns = chats(spark, sf)
    prompts = turns.filter("role = 'user'").select("conv_id", "turn", F.length("text").alias("prompt_chars"))
    replies = turns.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("reply_chars")
    )
    return J.pair_completions(prompts, replies, ["conv_id", "turn"])


@query(
    "reconcile",
    """WITH a AS (SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source),
b AS (SELECT source, count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY source)
SELECT source, a.n_rows AS manifest_n_rows, a.chars AS manifest_chars, coalesce(b.n_rows, 0) AS data_n_rows, coalesce(b.chars, 0) AS data_chars
FROM a LEFT JOIN b USING (source) WHERE a.n_rows IS DISTINCT FROM b.n_rows OR a.chars IS DISTINCT FROM b.chars""",
)
def reconcile(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    good = table(spark, sf, "labels").filter("quality = 1").select("doc_id")

    def counts(df):
        return df.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum("n_chars").alias("chars"))

    out = J.reconcile(counts(rows), counts(rows.join(good, "doc_id", "left_semi")), ["source"], ["n_rows", "chars"])
    return out.withColumn("data_n_rows", F.coalesce("data_n_rows", F.lit(0))).withColumn(
        "data_chars", F.coalesce("data_chars", F.lit(0))
    )


def prints_sql(keep: str) -> str:
    return rf"""WITH f AS (SELECT doc_id AS id, lang, regexp_extract_all(text, '\S+') AS t FROM documents),
k AS (SELECT id, lang, len(t) || '|' || array_to_string(t[1:40], ' ') || '|' || array_to_string(t[greatest(len(t) - 7, 1):], ' ') AS fp FROM f),
b AS (SELECT fp FROM k JOIN labels ON doc_id = id)
SELECT id FROM k WHERE fp {keep} (SELECT fp FROM b)"""


def prints(spark, sf):
    from ..functions.text import words

    rows = docs(spark, sf).select("id", words(F.col("text")).alias("tokens"))
    return rows, rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")


@query("fingerprint_match", prints_sql("IN"))
def fingerprint_match(spark, sf):
    """Rows equal, by fingerprint, to a labelled row."""
    return J.fingerprint_match(*prints(spark, sf)).select("id")


@query("fingerprint_exclude", prints_sql("NOT IN"))
def fingerprint_exclude(spark, sf):
    return J.fingerprint_match(*prints(spark, sf), keep=False).select("id")


# ---- samples and orders ----------------------------------------------------------------------------------------


@query("seeded_shuffle", f"SELECT doc_id AS id, row_number() OVER (ORDER BY {md5_sql(SEED, 'doc_id')}, doc_id) - 1 AS row_index FROM documents")
def seeded_shuffle(spark, sf):
    """The sorted table with every row's place in it."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return S.seeded_shuffle(seeded_index(rows, SEED, ["id"]), SEED, "id")


@query(
    "sample_n",
    f"""WITH p AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {md5_sql(SEED, 'doc_id')}, doc_id) - 1 AS draw FROM documents
WHERE doc_id IN (SELECT doc_id FROM labels)) SELECT id, draw, draw % 4 AS worker FROM p WHERE draw < (SELECT floor(count(*) * 0.4) FROM p)""",
)
def sample_n(spark, sf):
    """Two fifths of the labelled documents."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    allow = table(spark, sf, "labels").select(F.col("doc_id").alias("id"))
    n = rows.join(allow, "id", "left_semi").count()
    return S.sample_n(rows, int(n * 0.4), SEED, "id", allow, 4)


@query(
    "sample_replace",
    f"""WITH i AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {md5_sql(SEED, 'doc_id')}, doc_id) - 1 AS row_index FROM documents),
d AS (SELECT range AS draw, CAST('0x' || substr({md5_sql(f'{SEED}:draw', 'range')}, 1, 13) AS BIGINT) % (SELECT count(*) FROM documents) AS row_index FROM range(2000))
SELECT draw, id FROM d JOIN i USING (row_index)""",
)
def sample_replace(spark, sf):
    return S.sample_replace(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 2000, SEED, "id")


@query(
    "stratified_sample",
    f"""SELECT l_shipmonth AS stratum, l_orderkey * 10 + l_linenumber AS id FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_returnflag || l_linestatus AS l_shipmonth FROM lineitem)
QUALIFY row_number() OVER (PARTITION BY l_shipmonth ORDER BY {md5_sql(SEED, 'l_shipmonth', 'l_orderkey * 10 + l_linenumber')}, l_orderkey * 10 + l_linenumber) <= 50""",
)
def stratified_sample(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("stratum"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id")
    )
    return S.stratified_sample(rows.distinct(), "stratum", 50, SEED, "id")


@query(
    "stratified_quota",
    f"""SELECT o_orderpriority AS stratum, o_orderkey AS id FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {md5_sql(SEED, 'o_orderpriority', 'o_orderkey')}, o_orderkey) <= 1500""",
)
def stratified_quota(spark, sf):
    """A quota too large for trimming inside the tasks."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("stratum"), F.col("o_orderkey").alias("id"))
    return S.stratified_sample(rows, "stratum", 1500, SEED, "id")


@query("take_first", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 100")
def take_first(spark, sf):
    return S.take_first(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), 100, ["o_orderkey"])


@query(
    "every_kth",
    f"""SELECT id, row_index FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY {md5_sql(SEED, 'o_orderkey')}, o_orderkey) - 1 AS row_index FROM orders)
WHERE row_index % 3 = 0""",
)
def every_kth(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    return S.every_kth(seeded_index(rows, SEED, ["id"]), 3, "row_index")


@query("bernoulli", f"SELECT o_orderkey FROM orders WHERE {frac_sql(md5_sql(SEED, 'o_orderkey'))} < 0.05")
def bernoulli(spark, sf):
    return S.bernoulli(table(spark, sf, "orders").select("o_orderkey"), 0.05, SEED, "o_orderkey")


@query(
    "repeat_shuffled",
    f"""SELECT item_id, r AS repeat, row_number() OVER (PARTITION BY r ORDER BY {md5_sql(SEED, 'r', 'item_id')}, item_id) - 1 AS position
FROM benchmark, range(8) t(r)""",
)
def repeat_shuffled(spark, sf):
    return S.repeat_shuffled(table(spark, sf, "benchmark").select("item_id"), 8, SEED, "item_id")


@query("heaviest_first", f"WITH {D} SELECT id, n FROM d ORDER BY n DESC, id")
def heaviest_first(spark, sf):
    """The order itself is checked in the tests."""
    return S.heaviest_first(doc_stats(spark, sf).select("id", "n"), "n", "id")


@query(
    "capped_sample",
    f"""WITH e AS (SELECT event_id, user_id, CAST(least(4, floor(value / 20)) AS BIGINT) AS bucket FROM events),
a AS (SELECT *, {md5_sql(SEED, 'bucket', 'event_id')} AS h, row_number() OVER (PARTITION BY bucket, user_id ORDER BY {md5_sql(SEED, 'bucket', 'event_id')}, event_id) AS r FROM e)
SELECT event_id, user_id, bucket FROM a WHERE r <= 3 QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY h, event_id) <= 72""",
)
def capped_sample(spark, sf):
    """Users stand for tasks and value bands for context lengths."""
    bucket = F.least(F.lit(4), F.floor(F.col("value") / 20))
    rows = table(spark, sf, "events").select("event_id", "user_id", bucket.alias("bucket"))
    return S.capped_sample(rows, "user_id", "bucket", 3, 60, SEED, "event_id")


# ---- splits and packs ------------------------------------------------------------------------------------------


@query(
    "positional_split",
    f"""WITH i AS (SELECT doc_id AS id, row_number() OVER (ORDER BY {md5_sql(SEED, 'doc_id')}, doc_id) - 1 AS row_index FROM documents)
SELECT id, row_index, row_index >= CAST(floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) AS BIGINT) AS is_val FROM i""",
)
def positional_split(spark, sf):
    return S.positional_split(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 0.9, SEED, ["id"])


@query(
    "split_at_ratio",
    f"""WITH i AS (SELECT doc_id AS id, source, row_number() OVER (ORDER BY {md5_sql(SEED, 'doc_id')}, doc_id) - 1 AS row_index FROM documents)
SELECT id, source, row_index >= CAST(floor((SELECT count(*) FROM documents) * 0.9::DOUBLE) AS BIGINT) AS is_val FROM i""",
)
def split_at_ratio(spark, sf):
    return S.split_at_ratio(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), 0.9, SEED, ["id"])


@query(
    "shards_to_budget",
    f"""WITH {D}, s AS (SELECT CAST(substr(source, 4) AS INT) AS shard, CAST(sum(n) AS BIGINT) AS tokens, count(*) AS n_rows FROM d GROUP BY 1),
b AS (SELECT CAST(floor(sum(tokens) * 0.4) AS BIGINT) AS budget FROM s),
o AS (SELECT *, sum(tokens) OVER (ORDER BY {md5_sql(SEED, 'shard')}, shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
      FROM s WHERE shard < (SELECT max(shard) FROM s))
SELECT shard, tokens, n_rows FROM o, b WHERE coalesce(before, 0) < budget""",
)
def shards_to_budget(spark, sf):
    rows = doc_stats(spark, sf).withColumn("shard", F.substring("source", 4, 9).cast("int"))
    budget = int((rows.agg(F.sum("n").alias("t")).first().t or 0) * 0.4)
    return S.shards_to_budget(rows, budget, SEED)


PACKED = 512
PER_BUCKET = 20000


@query(
    "pack_rows",
    f"""WITH RECURSIVE {D},
nb AS (SELECT CAST(greatest(1, ceil(sum(n) / {float(PER_BUCKET)})) AS BIGINT) AS k FROM d),
b AS (SELECT id, n, {bucket_sql(md5_sql(SEED, 'id'), 'k')} AS bucket, {md5_sql(SEED, 'id')} AS h FROM d, nb),
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, id) AS r FROM b),
p AS (
  SELECT bucket, r, id, n, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS doc, CAST(0 AS BIGINT) AS start_ FROM o WHERE r = 1
  UNION ALL
  SELECT o.bucket, o.r, o.id, o.n, CASE WHEN p.start_ + p.n + o.n > {PACKED} THEN p.pack + 1 ELSE p.pack END,
         CASE WHEN p.start_ + p.n + o.n > {PACKED} THEN 0 ELSE p.doc + 1 END,
         CASE WHEN p.start_ + p.n + o.n > {PACKED} THEN 0 ELSE p.start_ + p.n END
  FROM p JOIN o ON o.bucket = p.bucket AND o.r = p.r + 1)
SELECT id, n, bucket, pack, doc, start_ AS "start" FROM p""",
)
def pack_rows(spark, sf):
    return S.pack_rows(doc_stats(spark, sf).select("id", "n"), PACKED, SEED, PER_BUCKET)


EDGES = """ed AS (SELECT doc_id AS node, md5(text) AS key FROM documents UNION SELECT doc_id, source || ':' || n_chars FROM documents)"""


def edges_of(spark, sf):
    base = table(spark, sf, "documents")
    return base.select(F.col("doc_id").alias("node"), F.md5("text").alias("key")).unionByName(
        base.select(F.col("doc_id").alias("node"), F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("key"))
    )


@query(
    "group_components",
    f"""WITH RECURSIVE {EDGES},
nn AS (SELECT DISTINCT a.node AS a, b.node AS b FROM ed a JOIN ed b USING (key)),
reach AS (SELECT a, b FROM nn UNION SELECT reach.a, nn.b FROM reach JOIN nn ON nn.a = reach.b)
SELECT a AS node, min(b) AS component FROM reach GROUP BY a""",
)
def group_components(spark, sf):
    """Documents that share a text, or a source and length, belong together."""
    return S.group_components(edges_of(spark, sf))


@query(
    "balance_groups",
    f"""WITH RECURSIVE {D}, g AS (SELECT source AS component, CAST(sum(n) AS BIGINT) AS weight FROM d GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY weight DESC, component) AS r FROM g),
p AS (
  SELECT r, component, weight, 0 AS shard, [CAST(weight AS DOUBLE), 0, 0, 0] AS loads FROM o WHERE r = 1
  UNION ALL
  SELECT o.r, o.component, o.weight, CAST(list_position(loads, list_min(loads)) - 1 AS INT),
         list_transform(loads, lambda x, i: CASE WHEN i = list_position(loads, list_min(loads)) THEN x + o.weight ELSE x END)
  FROM p JOIN o ON o.r = p.r + 1)
SELECT component, weight, shard FROM p""",
)
def balance_groups(spark, sf):
    groups = doc_stats(spark, sf).groupBy(F.col("source").alias("component")).agg(F.sum("n").alias("weight"))
    return S.balance_groups(groups, 4)


@query(
    "latest_per_key",
    "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id",
)
def latest_per_key(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return S.latest_per_key(rows, "user_id", ["ts", "event_id"]).drop("ts")


# ---- unions and mixes ------------------------------------------------------------------------------------------


@query(
    "union_sources",
    """SELECT 'docs:' || doc_id AS id, 'docs' AS source, n_chars, lang FROM documents
UNION ALL SELECT 'chats:' || conv_id || '-' || turn, 'chats', length(text), NULL FROM conversations
UNION ALL SELECT 'pages:' || page_id, 'pages', length(html), NULL FROM pages""",
)
def union_sources(spark, sf):
    return X.union_sources(
        {
            "docs": table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang"),
            "chats": chats(spark, sf).select(
                F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
                F.length("text").cast("bigint").alias("n_chars"),
            ),
            "pages": table(spark, sf, "pages").select(
                F.col("page_id").alias("id"), F.length("html").cast("bigint").alias("n_chars")
            ),
        }
    )


@query(
    "gather_parts",
    """SELECT doc_id AS "row", doc_id % 16 + CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 0 ELSE 1000 END AS part FROM documents""",
)
def gather_parts(spark, sf):
    """Labelled rows are the old parts, the others the new ones."""
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("row"), (F.col("doc_id") % 16).alias("part"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("row"))
    return X.gather_parts(rows.join(done, "row", "left_semi"), rows.join(done, "row", "left_anti"))


@query(
    "remove_source",
    "SELECT doc_id AS id, source FROM documents WHERE source <> 'src3'",
)
def remove_source(spark, sf):
    rows = docs(spark, sf).select("id", "source")
    return X.remove_source(rows, rows.filter("source = 'src3'"))


@query(
    "overlap",
    "SELECT count(*) AS shared FROM (SELECT text FROM documents WHERE lang = 'en' INTERSECT SELECT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))",
)
def overlap(spark, sf):
    base = docs(spark, sf).select("id", "lang", F.sha2("text", 256).alias("h"))
    held = base.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    return X.overlap(base.filter("lang = 'en'"), held, ["h"])


MIX = f"""{D}, org AS (SELECT id, source, n FROM d WHERE id IN (SELECT doc_id FROM labels)),
tg AS (SELECT id, source, n + 5 AS n, row_number() OVER (ORDER BY {md5_sql(SEED, 'id')}, id) AS r FROM d WHERE id NOT IN (SELECT id FROM org)),
ch AS (SELECT id, source, n FROM tg WHERE r <= (SELECT floor(count(*) * 0.5) FROM tg) + 20),
x AS (SELECT id, source, n, 'original' AS part, row_number() OVER (ORDER BY {md5_sql(f'{SEED}:original', 'id')}, id) <= 30 AS v FROM org
UNION ALL SELECT id, source, n, 'regenerated', row_number() OVER (ORDER BY {md5_sql(f'{SEED}:regenerated', 'id')}, id) <= 20 FROM ch),
mx AS (SELECT id, source, n, part, CASE WHEN v THEN 'val' ELSE 'train' END AS split FROM x)"""


@query("mix_datasets", f"WITH {MIX} SELECT * FROM mx")
def mix_datasets(spark, sf):
    """Labelled documents are the original part; every document, a little longer, was regenerated."""
    rows = doc_stats(spark, sf).select("id", "source", "n")
    original = rows.join(table(spark, sf, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi")
    others = rows.join(original.select("id"), "id", "left_anti").count()
    return X.mix_datasets(original, rows.withColumn("n", F.col("n") + 5), int(others * 0.5), 30, 20, SEED)


@query(
    "mix_report",
    f"""WITH {MIX} SELECT part, count(*) FILTER (split = 'train') AS train_rows, count(*) FILTER (split = 'val') AS val_rows,
 CAST(coalesce(sum(n) FILTER (split = 'train'), 0) AS BIGINT) AS train_tokens, CAST(coalesce(sum(n) FILTER (split = 'val'), 0) AS BIGINT) AS val_tokens,
 (count(*) FILTER (split = 'train') + 0.5::DOUBLE) / count(*) AS train_ratio FROM mx GROUP BY ROLLUP (part)""",
)
def mix_report(spark, sf):
    return X.mix_report(mix_datasets(spark, sf))


@query("share_quota", "SELECT source, count(*) AS n_rows, CAST(round_even(count(*) * 0.25::DOUBLE, 0) AS BIGINT) AS quota FROM documents GROUP BY source")
def share_quota(spark, sf):
    return X.share_quota(docs(spark, sf), "source", 0.25)


