"""Acceptance and throughput reports, counters, step logs. The event table stands for rollout and metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import joins as J
from ..operators.ordering import total_before
from ..sources import readers as R
from .registry import query, table


def events(spark, sf):
    return table(spark, sf, "events")


def hour():
    return F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")


HOUR = "date_diff('hour', TIMESTAMP '2024-01-01', ts)"


@query(
    "parse_metrics",
    """WITH l AS (SELECT event_type AS scrape, 'spec_decode_num_drafts' AS name, NULL::INT AS position, round(value, 2) AS x FROM events
UNION ALL SELECT event_type, 'spec_decode_num_accepted_tokens_per_pos', CAST(user_id % 8 AS INT), floor(value) FROM events)
SELECT scrape, name, coalesce(position, -1) AS position, round(sum(x), 4) AS total FROM l GROUP BY 1, 2, 3""",
)
def parse_metrics(spark, sf):
    """Three text lines per event: a comment, a plain counter and a counter with a position."""
    e = events(spark, sf)
    engine = F.concat(F.lit('{engine="'), F.col("user_id").cast("string"), F.lit('"'))
    lines = e.select(
        F.col("event_type").alias("scrape"),
        F.explode(
            F.array(
                F.lit("# TYPE spec_decode_num_drafts counter"),
                F.concat(F.lit("spec_decode_num_drafts_total"), engine, F.lit("} "), F.col("value").cast("string")),
                F.concat(
                    F.lit("spec_decode_num_accepted_tokens_per_pos_total"), engine, F.lit(',position="'),
                    (F.col("user_id") % 8).cast("string"), F.lit('"} '), F.floor("value").cast("string"),
                ),
            )
        ).alias("value"),
    )
    out = R.parse_metrics(lines, ["scrape"])
    return out.select("scrape", "name", F.coalesce("position", F.lit(-1)).alias("position"), F.round("total", 4).alias("total"))


@query(
    "parse_log_windows",
    """WITH w AS (SELECT event_type, CAST(floor(value) AS BIGINT) AS accepted, (CAST(floor(value) AS BIGINT) + user_id) / 3 AS drafts FROM events)
SELECT event_type, count(*) AS windows, CAST(sum(accepted) AS BIGINT) AS accepted, round(sum(drafts), 4) AS drafts,
       round(sum(0.5 * drafts) / sum(drafts), 6) AS rate_0, round(1 + sum(accepted) / sum(drafts), 6) AS acceptance_length
FROM w WHERE drafts > 0 GROUP BY 1""",
)
def parse_log_windows(spark, sf):
    """A metric line and a noise line per event."""
    accepted = F.floor("value")
    line = F.concat(
        F.lit("INFO 01-01 SpecDecoding metrics: Mean acceptance length: 2.50, Accepted throughput: 1.0 tokens/s, Accepted: "),
        accepted.cast("string"), F.lit(" tokens, Drafted: "), (accepted + F.col("user_id")).cast("string"),
        F.lit(" tokens, Per-position acceptance rate: 0.500, 0.300, 0.100, Avg Draft acceptance rate: 30.0%"),
    )
    lines = events(spark, sf).select("event_type", F.explode(F.array(line, F.lit("INFO other line"))).alias("value"))
    windows = R.parse_log_windows(lines, ["event_type"])
    return windows.groupBy("event_type").agg(
        F.count("*").alias("windows"),
        F.sum("accepted").alias("accepted"),
        F.round(F.sum("drafts"), 4).alias("drafts"),
        F.round(F.sum(F.col("rates")[0] * F.col("drafts")) / F.sum("drafts"), 6).alias("rate_0"),
        F.round(1 + F.sum("accepted") / F.sum("drafts"), 6).alias("acceptance_length"),
    )


def log_lines(spark, sf):
    """Four log lines per event; large values lose the closing line, and steps repeat within an hour."""
    e = events(spark, sf).withColumn("hour", hour())
    pad = " " * 20
    lines = F.array(
        F.concat(F.lit("[12:00:00] INFO     train/loss="), F.col("value").cast("string"), F.lit(",      trainer.py:569")),
        F.lit("tqdm 10%|#### other process"),
        F.concat(F.lit("\x1b[2m" + pad + "profile/engine="), F.col("user_id").cast("string"), F.lit(",\x1b[0m")),
        F.when(F.col("value") < 100, F.concat(F.lit(pad + "train/x=1e-3, global_step="), F.col("hour").cast("string"))),
    )
    return e.select(F.col("event_type").alias("file"), "event_id", F.posexplode(lines).alias("i", "value")).select(
        "file", (F.col("event_id") * 4 + F.col("i")).alias("line_no"), "value"
    ).filter("value IS NOT NULL")


@query(
    "assemble_log_records",
    f"""SELECT event_type AS file, {HOUR} AS step, value AS loss, user_id AS engine, event_id * 4 AS first_line FROM events WHERE value < 100""",
)
def assemble_log_records(spark, sf):
    records = R.assemble_log_records(log_lines(spark, sf)).filter("complete")
    return records.select(
        "file",
        "step",
        F.element_at("fields", F.lit("train/loss")).cast("double").alias("loss"),
        F.element_at("fields", F.lit("profile/engine")).cast("bigint").alias("engine"),
        "first_line",
    )


@query(
    "log_anomalies",
    f"""WITH x AS (SELECT event_type AS file, event_id, {HOUR} AS step, value < 100 AS done FROM events)
SELECT file, count(*) FILTER (NOT done) - CASE WHEN arg_max(done, event_id) THEN 0 ELSE 1 END AS truncated_blocks,
       count(DISTINCT step) FILTER (done) AS kept, count(*) FILTER (done) - count(DISTINCT step) FILTER (done) AS duplicate_steps,
       0 AS missing_keys FROM x GROUP BY file""",
)
def log_anomalies(spark, sf):
    return R.log_anomalies(R.assemble_log_records(log_lines(spark, sf)))


# ---- counters and rates ----------------------------------------------------------------------------------------


def scrapes(spark, sf):
    return events(spark, sf).select(
        F.col("user_id").alias("engine"), F.col("event_type").alias("name"), F.col("event_id").alias("scrape"),
        F.floor("value").cast("double").alias("value"),
    )


DELTA = """s AS (SELECT user_id AS engine, event_type AS name, event_id AS scrape, CAST(floor(value) AS DOUBLE) AS value,
  lag(CAST(floor(value) AS DOUBLE)) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events)"""


@query(
    "counter_delta",
    f"""WITH {DELTA} SELECT engine, name, scrape, value, coalesce(CASE WHEN value >= p THEN value - p WHEN p IS NOT NULL THEN value END, -1) AS delta FROM s""",
)
def counter_delta(spark, sf):
    out = E.counter_delta(scrapes(spark, sf), F.floor(F.col("scrape") / 1000))
    return out.withColumn("delta", F.coalesce("delta", F.lit(-1.0)))


@query(
    "acceptance",
    """WITH c AS (SELECT event_type AS subset, CAST(1 + floor(value / 10) AS BIGINT) AS drafts, CAST(floor(value / 3) AS BIGINT) AS acc,
 CAST(floor(value / 20) AS BIGINT) AS p0, CAST(floor(value / 40) AS BIGINT) AS p1, user_id % 10 = 0 AS lost FROM events)
SELECT coalesce(subset, 'all') AS subset, count(*) AS requests, count(*) FILTER (lost) AS failed, CAST(sum(drafts) AS BIGINT) AS drafts, CAST(sum(drafts * 5) AS BIGINT) AS draft_tokens, CAST(sum(acc) AS BIGINT) AS accepted_tokens,
 1 + sum(acc) / sum(drafts) AS acceptance_length, sum(p0) / sum(drafts) AS acceptance_at_pos_0, sum(p1) / sum(drafts) AS acceptance_at_pos_1
FROM c GROUP BY ROLLUP (subset)""",
)
def acceptance(spark, sf):
    drafts = 1 + F.floor(F.col("value") / 10)
    counters = events(spark, sf).select(
        F.col("event_type").alias("subset"), drafts.alias("drafts"), (drafts * 5).alias("draft_tokens"),
        F.floor(F.col("value") / 3).alias("accepted_tokens"),
        F.floor(F.col("value") / 20).alias("pos_0"), F.floor(F.col("value") / 40).alias("pos_1"),
        F.lit(1).alias("requests"), (F.col("user_id") % 10 == 0).cast("int").alias("failed"),
    )
    return E.acceptance(counters, "subset", 2, ("requests", "failed"))


ARMS = """rs AS (SELECT event_type AS benchmark, CASE WHEN user_id % 2 = 0 THEN 'plain-' ELSE '' END || 'arm' || (user_id // 2 % 3) AS arm,
 'c' || (user_id // 6 % 2) AS level, CAST(sum(floor(value)) AS BIGINT) AS tokens, count(*) AS seconds FROM events GROUP BY 1, 2, 3)"""


def results(spark, sf):
    arm = F.concat(
        F.when(F.col("user_id") % 2 == 0, "plain-").otherwise(""), F.lit("arm"), (F.floor(F.col("user_id") / 2) % 3).cast("string")
    )
    runs = events(spark, sf).select(
        F.col("event_type").alias("benchmark"), arm.alias("arm"),
        F.concat(F.lit("c"), (F.floor(F.col("user_id") / 6) % 2).cast("string")).alias("level"),
        F.floor("value").alias("tokens"), F.lit(1).cast("bigint").alias("seconds"),
    )
    return runs


@query(
    "throughput",
    f"WITH {ARMS} SELECT benchmark, arm, level, tokens, seconds, tokens / seconds AS tokens_per_s FROM rs",
)
def throughput(spark, sf):
    return E.throughput(results(spark, sf), ["benchmark", "arm", "level"])


PAIRS = f"""{ARMS}, pr AS (SELECT a.benchmark, a.arm, a.level, a.tokens, a.seconds, p.tokens AS plain_tokens, p.seconds AS plain_seconds
FROM rs a JOIN rs p ON p.arm = 'plain-' || a.arm AND p.benchmark = a.benchmark AND p.level = a.level)"""


@query("pair_arms", f"WITH {PAIRS} SELECT * FROM pr")
def pair_arms(spark, sf):
    return J.pair_arms(E.throughput(results(spark, sf), ["benchmark", "arm", "level"]).drop("tokens_per_s"))


@query(
    "speedup",
    f"""WITH {PAIRS} SELECT benchmark, arm, level, plain_tokens / plain_seconds AS plain_tok_s, tokens / seconds AS tok_s,
(tokens / seconds) / (plain_tokens / plain_seconds) AS speedup FROM pr WHERE plain_tokens > 0""",
)
def speedup(spark, sf):
    return E.speedup(pair_arms(spark, sf))


@query(
    "two_arm_table",
    """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS mode, event_type AS task,
 CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS arm, 1 + floor(value) / 100 AS al FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 0))
SELECT mode, task, round(coalesce(avg(al) FILTER (arm = 'a'), -1), 6) AS a_mean, round(coalesce(max(al) FILTER (arm = 'a') - min(al) FILTER (arm = 'a'), -1), 6) AS a_spread, count(*) FILTER (arm = 'a') AS a_runs,
 round(avg(al) FILTER (arm = 'b'), 6) AS b_mean, round(max(al) FILTER (arm = 'b') - min(al) FILTER (arm = 'b'), 6) AS b_spread, count(*) FILTER (arm = 'b') AS b_runs,
 round(coalesce(avg(al) FILTER (arm = 'a') - avg(al) FILTER (arm = 'b'), -9), 6) AS gap FROM r GROUP BY 1, 2""",
)
def two_arm_table(spark, sf):
    """One task has no run of the first arm."""
    out = two_arms(spark, sf)
    return out.select(
        "mode", "task",
        F.round(F.coalesce("a_mean", F.lit(-1.0)), 6).alias("a_mean"), F.round(F.coalesce("a_spread", F.lit(-1.0)), 6).alias("a_spread"),
        F.coalesce("a_runs", F.lit(0)).alias("a_runs"),
        F.round("b_mean", 6).alias("b_mean"), F.round("b_spread", 6).alias("b_spread"), "b_runs",
        F.round(F.coalesce("gap", F.lit(-9.0)), 6).alias("gap"),
    )


def two_arms(spark, sf):
    third = F.col("user_id") % 3 == 0
    runs = events(spark, sf).filter(~((F.col("event_type") == "view") & third)).select(
        F.when(F.col("user_id") % 2 == 0, "on").otherwise("off").alias("mode"), F.col("event_type").alias("task"),
        F.when(third, "a").otherwise("b").alias("arm"), F.col("user_id").alias("seed"),
        (1 + F.floor("value") / 100).alias("acceptance_length"),
    )
    return E.two_arm_table(runs, ["a", "b"])


@query(
    "mean_gap",
    """WITH r AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'on' ELSE 'off' END AS mode, event_type AS task,
 CASE WHEN user_id % 3 = 0 THEN 'a' ELSE 'b' END AS arm, 1 + floor(value) / 100 AS al FROM events WHERE NOT (event_type = 'view' AND user_id % 3 = 0)),
g AS (SELECT mode, task, avg(al) FILTER (arm = 'a') - avg(al) FILTER (arm = 'b') AS gap FROM r GROUP BY 1, 2)
SELECT mode, round(avg(gap), 6) AS mean_gap, count(gap) AS tasks FROM g GROUP BY mode""",
)
def mean_gap(spark, sf):
    return E.mean_gap(two_arms(spark, sf)).withColumn("mean_gap", F.round("mean_gap", 6))


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query(
    "method_summary",
    """WITH m AS (SELECT n_name AS method, c_mktsegment AS benchmark, c_custkey, c_acctbal FROM customer JOIN nation ON n_nationkey = c_nationkey),
s AS (SELECT method, benchmark, avg(floor(c_acctbal)) AS al FROM m GROUP BY 1, 2),
o AS (SELECT method, count(*) AS r, sum(floor(o_totalprice)) AS t, sum(floor(o_totalprice / 2)) AS u FROM orders JOIN m ON o_custkey = c_custkey GROUP BY 1)
SELECT method, round(t / r, 4) AS tokens_per_row, round(u / r, 4) AS supervised_per_row, round(r * 0.9 / 50, 6) AS rows_per_step, 120 / 50 AS epochs_seen,
 round(u * 0.9 / 50 * 120, 2) AS supervised_seen, round(least(u * 0.9 / 50 * 120, u * 0.9), 2) AS unique_supervised_seen,
 round(coalesce((SELECT CASE WHEN count(*) = 5 THEN avg(al) END FROM s WHERE s.method = o.method
   AND benchmark IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')), -1), 4) AS mean_neutral FROM o""",
)
def method_summary(spark, sf):
    """Nations stand for methods, market segments for the neutral benchmarks."""
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("method"))
    m = table(spark, sf, "customer").join(nations, "c_nationkey")
    runs = m.groupBy("method", F.col("c_mktsegment").alias("benchmark")).agg(F.avg(F.floor("c_acctbal")).alias("acceptance_length"))
    orders = table(spark, sf, "orders").join(m.select(F.col("c_custkey").alias("o_custkey"), "method"), "o_custkey")
    data = orders.groupBy("method").agg(
        F.count("*").alias("rows"), F.sum(F.floor("o_totalprice")).alias("tokens"), F.sum(F.floor(F.col("o_totalprice") / 2)).alias("supervised")
    ).select("*", F.lit(0.9).alias("train_share"), F.lit(50).alias("epoch_steps"), F.lit(120).alias("step"))
    out = E.method_summary(runs, data, SEGMENTS)
    return out.select(
        "method", F.round("tokens_per_row", 4).alias("tokens_per_row"), F.round("supervised_per_row", 4).alias("supervised_per_row"),
        F.round("rows_per_step", 6).alias("rows_per_step"), "epochs_seen", F.round("supervised_seen", 2).alias("supervised_seen"),
        F.round("unique_supervised_seen", 2).alias("unique_supervised_seen"), F.round(F.coalesce("mean_neutral", F.lit(-1.0)), 4).alias("mean_neutral"),
    )


@query(
    "accepted_length",
    """WITH l AS (SELECT l_orderkey AS block, l_returnflag <> 'R' AS ok, sqrt(1 - l_discount) AS rate,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS slot FROM lineitem),
x AS (SELECT *, product(rate) OVER (PARTITION BY block ORDER BY slot) AS p, bool_and(ok) OVER (PARTITION BY block ORDER BY slot) AS run FROM l)
SELECT block, 1 + count(*) FILTER (run) AS accepted, round(1 + sum(p), 6) AS expected FROM x GROUP BY block""",
)
def accepted_length(spark, sf):
    """Orders stand for blocks and their lines for draft slots."""
    lines = table(spark, sf, "lineitem")
    slots = lines.groupBy(F.col("l_orderkey").alias("block")).agg(
        F.sort_array(
            F.collect_list(
                F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", (F.col("l_returnflag") != "R").alias("ok"),
                         F.sqrt(1 - F.col("l_discount")).alias("rate"))
            )
        ).alias("s")
    )
    blocks = slots.select("block", F.col("s.ok").alias("correct"), F.col("s.rate").alias("rate"))
    return E.accepted_length(blocks).withColumn("expected", F.round("expected", 6))


# ---- curves and step logs --------------------------------------------------------------------------------------


def dense_log(spark, sf):
    """``arm, done, accept`` with ``done`` counting each arm's events."""
    rows = events(spark, sf).select(F.col("event_type").alias("arm"), "event_id", F.sqrt("value").alias("accept"))
    counted = total_before(rows, ["arm"], ["event_id"], F.floor(F.col("event_id") / 10000), F.lit(1).cast("bigint"), "b")
    return counted.select("arm", (F.col("b") + 1).alias("done"), "accept")


LOG = "lg AS (SELECT event_type AS arm, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS done, sqrt(value) AS accept FROM events)"


@query(
    "accept_curve",
    f"""WITH {LOG} SELECT arm, CAST(ceil(done / 100) - 1 AS BIGINT) AS bin, count(*) AS n_rows, round(avg(accept), 6) AS mean_accept FROM lg GROUP BY 1, 2""",
)
def accept_curve(spark, sf):
    return E.accept_curve(dense_log(spark, sf), 100).withColumn("mean_accept", F.round("mean_accept", 6))


@query(
    "moving_average",
    f"""WITH {LOG} SELECT arm, done * 16 AS done, round(avg(accept) OVER (PARTITION BY arm ORDER BY done ROWS BETWEEN 20 PRECEDING AND CURRENT ROW), 5) AS smooth FROM lg""",
)
def moving_average(spark, sf):
    """``done`` grows by batches of 16, as a rollout log's does."""
    log = dense_log(spark, sf).withColumn("done", F.col("done") * 16)
    return E.moving_average(log, 20).withColumn("smooth", F.round("smooth", 5))


@query(
    "first_per_step",
    f"""SELECT user_id AS run, {HOUR} AS step, min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) - 1 AS duplicates
FROM events GROUP BY 1, 2""",
)
def first_per_step(spark, sf):
    log = events(spark, sf).select(F.col("user_id").alias("run"), hour().alias("step"), "event_id", "event_type")
    return E.first_per_step(log, ["run", "step"], "event_id")


@query(
    "missing_steps",
    f"""WITH s AS (SELECT DISTINCT user_id AS run, {HOUR} AS step FROM events),
g AS (SELECT run, step, lag(step) OVER (PARTITION BY run ORDER BY step) AS p FROM s)
SELECT run, unnest(range(p + 1, step)) AS step FROM g WHERE step - p > 1""",
)
def missing_steps(spark, sf):
    log = events(spark, sf).select(F.col("user_id").alias("run"), hour().alias("step"))
    return E.missing_steps(log, "run", "step", 100)
