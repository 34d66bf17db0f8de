"""Readers and writers: the tables are written to the shared folder in the source's format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import word_count
from ..operators import conversations as V
from ..operators import token_rows as T
from ..session import fresh_path, settle
from ..sources import readers as R
from ..sources import writers as K
from .chats import PICKED
from .registry import CHAT, CTOK, SEED, D, bucket_sql, chat_mode, chat_rows, chats, doc_stats, md5_sql, query, table


@query("read_rows", "SELECT doc_id, source FROM documents")
def read_rows(spark, sf):
    return R.read_rows(spark, f"{sf}/documents.parquet", ["doc_id", "source"])


@query(
    "read_union",
    """SELECT doc_id AS id, n_chars, lang, NULL AS label FROM documents UNION ALL SELECT vec_id, NULL, NULL, label FROM embeddings""",
)
def read_union(spark, sf):
    a, b = fresh_path(spark, "union-a"), fresh_path(spark, "union-b")
    table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "n_chars", "lang").write.parquet(a)
    table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label").write.parquet(b)
    return R.read_union(spark, [a, b])


@query(
    "read_jsonl",
    "SELECT conv_id, turn, role, md5(replace(text, E'\\n', chr(8232))) AS text_md5 FROM conversations",
)
def read_jsonl(spark, sf):
    """Texts hold U+2028 in place of line feeds; it must not end a record."""
    path = fresh_path(spark, "jsonl")
    rows = chats(spark, sf).withColumn("text", F.translate("text", "\n", "\u2028"))
    rows.write.json(path)
    back = R.read_jsonl(spark, path, rows.schema)
    return back.select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query("read_json_array", "SELECT conv_id, turn, role, md5(text) AS text_md5 FROM conversations")
def read_json_array(spark, sf):
    """One file per hundred conversations, each a single JSON array of from/value conversations."""
    path = fresh_path(spark, "arrays")
    convs = chats(spark, sf).groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("m")
    )
    named = convs.select(
        F.floor(F.col("conv_id") / 100).alias("file"),
        F.struct("conv_id", F.transform("m", lambda x: F.struct(x["from"].alias("from"), x["value"].alias("value"))).alias("conversations")).alias("c"),
    )
    arrays = named.groupBy("file").agg(F.to_json(F.collect_list("c")).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(path)
    back = R.read_json_array(spark, path, "conv_id bigint, conversations array<struct<from:string,value:string>>")
    return V.to_turns(back).select("conv_id", "turn", "role", F.md5("text").alias("text_md5"))


@query(
    "read_log_lines",
    """WITH f AS (SELECT source, regexp_split_to_array(string_agg(replace(coalesce(text, ''), ',', chr(13)) || chr(10), '' ORDER BY doc_id), '\\r\\n|\\r|\\n') AS parts
 FROM documents GROUP BY source)
SELECT source, unnest(range(0, len(parts) - 1)) AS line_no, md5(unnest(parts[:len(parts) - 1])) AS value_md5 FROM f""",
)
def read_log_lines(spark, sf):
    """One log per source, in which commas are carriage returns; a split holds 256 KiB."""
    path = fresh_path(spark, "logs")
    rows = table(spark, sf, "documents").select("source", "doc_id", F.translate(F.coalesce("text", F.lit("")), ",", "\r").alias("value"))
    placed = rows.repartition("source").sortWithinPartitions("source", "doc_id")
    placed.select("source", "value").write.partitionBy("source").text(path)
    name, before = "spark.sql.files.maxPartitionBytes", spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set(name, "256k")
    try:
        lines = R.read_log_lines(spark, path, "*.txt")
    finally:
        spark.conf.set(name, before)
    return lines.select(F.regexp_extract("file", "source=([^/]+)/", 1).alias("source"), "line_no", F.md5("value").alias("value_md5"))


@query(
    "explode_trajectories",
    """SELECT CAST(conv_id AS VARCHAR) AS task, turn AS i, length(text) + 1 AS prompt_tokens, length(text) AS completion_tokens
FROM conversations WHERE role = 'assistant' AND turn % 2 = 1""",
)
def explode_trajectories(spark, sf):
    """Compressed JSON lines, one conversation each; usage is recorded on some messages only."""
    path = fresh_path(spark, "traces")
    usage = F.when(
        F.col("turn") % 2 == 1,
        F.struct((F.length("text") + 1).alias("prompt_tokens"), F.length("text").alias("completion_tokens")),
    )
    rows = chats(spark, sf).groupBy(F.col("conv_id").cast("string").alias("task_name")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", usage.alias("usage")))).alias("messages")
    )
    rows.write.option("compression", "gzip").json(path)
    shape = "task_name string, messages array<struct<role:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>"
    return R.explode_trajectories(R.read_jsonl(spark, path, shape))


@query(
    "attempt_messages",
    """SELECT CAST(conv_id AS VARCHAR) AS task, turn AS i, length(text) + 1 AS prompt_tokens, length(text) AS completion_tokens
FROM conversations WHERE role = 'assistant' AND turn % 2 = 1""",
)
def attempt_messages(spark, sf):
    """Published records: every conversation in two attempts beside one without a trajectory, usage deep in each message."""
    path = fresh_path(spark, "attempts")
    usage = F.struct((F.length("text") + 1).alias("prompt_tokens"), F.length("text").alias("completion_tokens"))
    extra = F.when(F.col("turn") % 2 == 1, F.struct(F.struct(usage.alias("usage")).alias("response")))
    turns = chats(spark, sf).select("conv_id", "turn", "role", extra.alias("extra"))
    said = turns.groupBy(F.col("conv_id").cast("string").alias("task_name")).agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "extra"))).alias("m")
    )
    attempt = lambda messages: F.struct(F.struct(messages.alias("messages")).alias("trajectory"))
    none = F.lit(None).cast(said.schema["m"].dataType)
    attempts = F.array(attempt(F.filter("m", lambda x: x["turn"] < 2)), attempt(none), attempt(F.filter("m", lambda x: x["turn"] >= 2)))
    said.select("task_name", attempts.alias("attempts")).write.option("compression", "gzip").json(path)
    return R.explode_trajectories(R.attempt_messages(R.read_jsonl(spark, path, ATTEMPTS)))


ATTEMPTS = (
    "task_name string, attempts array<struct<trajectory:struct<messages:array<struct<role:string,extra:struct<response:"
    "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>>>>>>"
)


@query(
    "read_trials",
    "SELECT source AS trial, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS step, doc_id, n_chars FROM documents",
)
def read_trials(spark, sf):
    """One document of many lines per trial, with the trial's steps."""
    path = fresh_path(spark, "trials")
    steps = F.sort_array(F.collect_list(F.struct("doc_id", "n_chars")))
    trials = table(spark, sf, "documents").groupBy(F.col("source").alias("trial_name")).agg(steps.alias("steps"))
    lines = F.replace(F.to_json(F.struct("steps")), F.lit(","), F.lit(",\n"))
    trials.select("trial_name", lines.alias("value")).write.partitionBy("trial_name").text(path)
    schema = "steps array<struct<doc_id:bigint,n_chars:bigint>>"
    steps = R.trial_steps(R.read_trials(spark, path, schema, r"trial_name=([^/]+)/"))
    return steps.select("trial", "step", "s.doc_id", "s.n_chars")


def _runs(spark, sf):
    path = fresh_path(spark, "results")
    e = table(spark, sf, "events")
    runs = e.groupBy(
        F.col("event_type").alias("arm"), F.lit("mix").alias("benchmark"), F.lit("c16").alias("level"),
        F.expr("dayofmonth(ts)").alias("seed"),
    ).agg(F.sum(F.floor("value")).alias("tok"), F.count("*").alias("n"))
    keys = ["arm", "benchmark", "level", "seed"]
    wrapped = runs.select(
        *keys,
        F.struct(F.col("tok").alias("avg")).alias("output_tokens"),
        F.struct(F.col("n").alias("value")).alias("requests"),
        (F.col("n") * 2).alias("wall_s"),
    )
    wrapped.repartition(*keys).write.partitionBy(*keys).json(path)
    status = runs.select(*keys, F.concat(F.lit("exit="), (F.col("n") % 3).cast("string"), F.lit("\n")).alias("value"))
    status.repartition(*keys).write.mode("append").partitionBy(*keys).text(path)
    return path, R.read_results(spark, path, "*.json", ["output_tokens", "requests", "wall_s"])


RUNS = """r AS (SELECT event_type AS arm, 'mix' AS benchmark, 'c16' AS level, dayofmonth(ts) AS seed, sum(floor(value))::DOUBLE AS output_tokens,
count(*)::DOUBLE AS requests, count(*) * 2.0::DOUBLE AS wall_s FROM events GROUP BY ALL)"""


@query("read_results", f"WITH {RUNS} SELECT * FROM r")
def read_results(spark, sf):
    return _runs(spark, sf)[1].drop("run")


@query(
    "with_acceptance",
    f"""WITH {RUNS} SELECT *, CASE WHEN seed % 3 = 0 THEN NULL WHEN seed % 2 = 0 THEN requests + 0.5::DOUBLE ELSE requests END AS acceptance_length FROM r""",
)
def with_acceptance(spark, sf):
    """Tables beside the metrics: one row, or several with a pooled one; every third seed has none."""
    path, runs = _runs(spark, sf)
    keys = ["arm", "benchmark", "level", "seed"]
    row = lambda subset, more: F.struct(F.lit(subset).alias("subset"), (F.col("requests") + more).alias("acceptance_length"))
    rows = F.when(F.col("seed") % 2 == 0, F.array(row("first", 0.0), row("all", 0.5), row("later", 1.0))).otherwise(F.array(row("first", 0.0)))
    tables = runs.filter("seed % 3 <> 0").select(*keys, F.explode(rows).alias("t")).select(*keys, "t.*")
    tables.repartition(*keys).write.mode("append").partitionBy(*keys).csv(path, header=True)
    return R.with_acceptance(spark, runs, path, "*.csv").drop("run")


@query("successful_runs", f"WITH {RUNS} SELECT * FROM r WHERE CAST(requests AS INT) % 3 = 0")
def successful_runs(spark, sf):
    path, runs = _runs(spark, sf)
    return R.successful_runs(spark, runs, path, "*.txt").drop("run")


# ---- writers ---------------------------------------------------------------------------------------------------

N_SHARDS = 8


@query(
    "write_sharded",
    f"""WITH s AS (SELECT doc_id AS id, {bucket_sql('md5(CAST(doc_id AS VARCHAR))', N_SHARDS)} AS shard FROM documents)
SELECT id, shard, row_number() OVER (PARTITION BY shard ORDER BY {md5_sql(SEED, 'shard', 'id')}, id) - 1 AS place FROM s""",
)
def write_sharded(spark, sf):
    """Written and read back; the place inside the shard's file is taken from the file itself."""
    path = fresh_path(spark, "shards")
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source", "text")
    K.write_sharded(rows, path, N_SHARDS, SEED)
    back = spark.read.parquet(path).select("id", F.col("shard").cast("int").alias("shard"), "h", F.col("_metadata.row_index").alias("place"))
    return back.drop("h")


@query(
    "manifest",
    f"""WITH {CHAT}, x AS (SELECT CASE WHEN f < 0.4 THEN 'think' WHEN f < 0.8 THEN 'nothink' ELSE 'none' END AS source, len(tokens) AS n,
 CAST(list_sum(mask) AS BIGINT) AS s FROM c JOIN modes ON conv_id = id)
SELECT coalesce(source, 'ALL') AS source, count(*) AS rows_kept, CAST(sum(n) AS BIGINT) AS tokens_kept, CAST(sum(s) AS BIGINT) AS tokens_supervised,
 {SEED} AS seed, 32768 AS seq_length, false AS partial FROM x GROUP BY ROLLUP (source)""",
)
def manifest(spark, sf):
    """Written as JSON lines and read back."""
    path = fresh_path(spark, "manifest")
    rows = chat_rows(spark, sf).select(
        F.coalesce(chat_mode("id"), F.lit("none")).alias("source"), "n", T.supervised(F.col("mask")).alias("n_supervised")
    )
    K.write_manifest(rows, path, seed=SEED, length=32768)
    shape = "source string, rows_kept bigint, tokens_kept bigint, tokens_supervised bigint, seed int, seq_length int, partial boolean"
    return R.read_jsonl(spark, path, shape).withColumn("source", F.coalesce("source", F.lit("ALL")))


@query("write_token_freq", f"WITH {CTOK} SELECT token, count(*) AS cnt FROM t WHERE m = 1 GROUP BY token")
def write_token_freq(spark, sf):
    path = fresh_path(spark, "freq")
    K.write_token_freq(chat_rows(spark, sf), path)
    return spark.read.parquet(path)


def prompt_set(spark, sf):
    """First and later assistant turns with their prompt lengths in tokens."""
    turns = chats(spark, sf)
    picked = V.pick_turns(turns, SEED)
    sizes = turns.select("conv_id", F.col("turn").alias("t"), word_count(F.col("text")).alias("w"))
    prompts = picked.join(sizes, "conv_id").filter("t < turn").groupBy("conv_id", "turn", "turn_kind").agg(
        F.sum("w").alias("prompt_tokens")
    )
    return prompts.withColumn("assistant_turn", F.floor(F.col("turn") / 2))


PROMPTS = rf"""{PICKED},
ps AS (SELECT pk.conv_id, pk.turn, turn_kind, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS prompt_tokens, pk.turn // 2 AS assistant_turn
FROM pk JOIN conversations c ON c.conv_id = pk.conv_id AND c.turn < pk.turn GROUP BY ALL)"""


@query(
    "prompt_manifest",
    f"""WITH {PROMPTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY turn_kind ORDER BY prompt_tokens) - 1 AS i, count(*) OVER (PARTITION BY turn_kind) AS c FROM ps)
SELECT turn_kind, count(*) AS n_rows, max(CASE WHEN i = c // 2 THEN prompt_tokens END) AS median_rank, max(prompt_tokens) AS longest,
 CAST(sum(CAST('0x' || substr(md5(conv_id || '|' || turn), 1, 12) AS HUGEINT)) AS VARCHAR) AS checksum FROM rk GROUP BY turn_kind""",
)
def prompt_manifest(spark, sf):
    return K.prompt_manifest(prompt_set(spark, sf), ["conv_id", "turn"])


@query(
    "turn_histogram",
    f"WITH {PROMPTS} SELECT turn_kind, assistant_turn, count(*) AS n_prompts FROM ps GROUP BY 1, 2",
)
def turn_histogram(spark, sf):
    return K.turn_histogram(prompt_set(spark, sf))


@query(
    "prompt_set_manifest",
    f"""WITH {PROMPTS} SELECT turn_kind, sum(count(*)) OVER (PARTITION BY turn_kind) AS n_rows, assistant_turn, count(*) AS n_prompts, 0 AS train_overlap FROM ps GROUP BY turn_kind, assistant_turn""",
)
def prompt_set_manifest(spark, sf):
    """The manifest beside the written prompts, one row per bar of its histogram."""
    path = fresh_path(spark, "prompts")
    prompts = settle(prompt_set(spark, sf), "set")
    train = chats(spark, sf).select("conv_id").distinct().join(prompts.select("conv_id"), "conv_id", "left_anti")
    K.write_prompt_set(prompts, path, ["conv_id", "turn"], train, ["conv_id"])
    shape = "turn_kind string, n_rows bigint, train_overlap bigint, turn_histogram array<struct<assistant_turn:bigint,n_prompts:bigint>>"
    return spark.read.schema(shape).json(path + "/manifest").select("turn_kind", "n_rows", "train_overlap", F.inline("turn_histogram"))


@query("write_prompt_set", f"WITH {PROMPTS} SELECT conv_id, turn, turn_kind, prompt_tokens, assistant_turn FROM ps")
def write_prompt_set(spark, sf):
    """Written behind the leak check (training rows: conversations without an assistant turn) and read back."""
    path = fresh_path(spark, "prompts")
    prompts = settle(prompt_set(spark, sf), "set")
    train = chats(spark, sf).select("conv_id").distinct().join(prompts.select("conv_id"), "conv_id", "left_anti")
    K.write_prompt_set(prompts, path, ["conv_id", "turn"], train, ["conv_id"])
    back = spark.read.schema("conv_id bigint, turn bigint, prompt_tokens bigint, assistant_turn bigint, turn_kind string").json(path + "/prompts")
    return back


@query(
    "write_report",
    f"""WITH {D} SELECT source, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS tokens, round(sum(n) / count(*), 4) AS mean_tokens FROM d GROUP BY source""",
)
def write_report(spark, sf):
    path = fresh_path(spark, "report")
    report = doc_stats(spark, sf).groupBy("source").agg(
        F.count("*").alias("n_rows"), F.sum("n").alias("tokens"), F.round(F.sum("n") / F.count("*"), 4).alias("mean_tokens")
    )
    K.write_report(report, path)
    return spark.read.csv(path, header=True, schema="source string, n_rows bigint, tokens bigint, mean_tokens double")


@query("safe_write", "SELECT doc_id, lang FROM documents")
def safe_write(spark, sf):
    """Written once; a second write to the same place must be refused."""
    path = fresh_path(spark, "safe")
    rows = table(spark, sf, "documents").select("doc_id", "lang")
    K.safe_write(rows, path, [f"{sf}/documents.parquet"])
    try:
        K.safe_write(rows, path)
    except Exception as e:  # noqa: BLE001 - the refusal is the point
        if "ALREADY_EXISTS" not in str(e):
            raise
        return spark.read.parquet(path)
    raise AssertionError("the second write was not refused")
