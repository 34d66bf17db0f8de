"""Streams with bounded state, split log files, and the split by the key at the cut."""

import os

from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.operators import selection as S
from tallyloom.sources import readers as R
from tallyloom.streaming import jobs as Z


def files_of(path):
    """Files below a folder with their sizes; times would tell a rewritten file."""
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def local(path):
    return path.removeprefix("file://").removeprefix("file:")


def batches_of(spark, batches, shape, name):
    """A file stream with one batch per list of rows."""
    path = session.fresh_path(spark, name)
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(path)


def updated(query):
    return [sum(s.numRowsUpdated for s in p.stateOperators) for p in query.recentProgress if p.numInputRows]


def rows_written(spark, path, batches):
    return [spark.read.parquet(f"{path}/data/run={b}").count() for b in range(batches)]


def test_counter_state_follows_the_batch(spark):
    """Ten batches: the first has 200 counters, each later one a single counter; a batch writes as many states as it has."""
    shape = "engine string, name string, scrape bigint, value double"
    batches = [[(f"e{i}", "c", 0, float(i)) for i in range(200)]] + [[(f"e{b}", "c", b, b * 10.0)] for b in range(1, 10)]
    out = session.fresh_path(spark, "deltas")
    Z.stream_counter_delta(batches_of(spark, batches, shape, "scrapes"), out, session.fresh_path(spark, "state"), parts=4)
    written = rows_written(spark, out + "/state", 10)
    assert written[0] == 200 and max(written[1:]) <= 9 and sum(written[1:]) < 30
    got = {(r.engine, r.scrape): r.delta for r in spark.read.parquet(out + "/deltas").filter("scrape > 0").collect()}
    assert got == {(f"e{b}", b): b * 10.0 - b for b in range(1, 10)}


def test_counters_reset_come_late_and_repeat(spark):
    shape = "engine string, name string, scrape bigint, value double"
    batches = [[("e", "c", 3, 9.0), ("e", "c", 1, 5.0), ("f", "c", 1, 1.0)], [("e", "c", 2, 7.0)], [("e", "c", 5, 1.0), ("e", "c", 4, 12.0), ("f", "c", 2, 4.0)]]
    out = session.fresh_path(spark, "deltas")
    Z.stream_counter_delta(batches_of(spark, batches, shape, "scrapes"), out, session.fresh_path(spark, "state"))
    got = {(r.engine, r.scrape): r.delta for r in spark.read.parquet(out + "/deltas").collect()}
    assert got == {("e", 1): None, ("e", 3): 4.0, ("e", 2): None, ("e", 4): 3.0, ("e", 5): 1.0, ("f", 1): None, ("f", 2): 3.0}


def test_untouched_parts_keep_their_files(spark):
    shape = "key string, version bigint, body string"
    batches = [[(f"k{i}", 0, "old") for i in range(400)], [("k7", 1, "new"), ("k7", 2, "newer")], [("k7", 1, "late"), ("k9", 5, "x")]]
    path, state = session.fresh_path(spark, "latest"), session.fresh_path(spark, "state")
    folder = session.fresh_path(spark, "updates")
    seen = []
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        Z.stream_latest(spark.readStream.schema(shape).parquet(folder), path, state, "key", ["version"], parts=16)
        seen.append(files_of(local(path) + "/data"))
    assert all(seen[2].get(f) == at for f, at in seen[0].items()) and len(seen[1]) == len(seen[0]) + 1
    table = {r.key: (r.version, r.body) for r in Z.newest_version(spark, path).collect()}
    assert len(table) == 400 and table["k7"] == (2, "newer") and table["k9"] == (5, "x") and table["k8"] == (0, "old")
    assert Z.superseded(spark, path) == 4


def test_runs_of_a_part_stay_few(spark):
    shape = "key string, version bigint"
    batches = [[(f"k{b}-{i}", b) for i in range(20)] + [("hot", b)] for b in range(12)]
    path = session.fresh_path(spark, "latest")
    Z.stream_latest(batches_of(spark, batches, shape, "updates"), path, session.fresh_path(spark, "state"), "key", ["version"], parts=2)
    runs = Z._runs(spark, path, 11)
    assert max(sum(r.part == p for r in runs) for p in range(2)) <= 4
    rows = Z.newest_version(spark, path).collect()
    assert len(rows) == 241 and [r.version for r in rows if r.key == "hot"] == [11] and Z.superseded(spark, path) == 11


def test_an_empty_batch_leaves_the_table(spark):
    shape = "key string, version bigint"
    path = session.fresh_path(spark, "latest")
    Z.stream_latest(batches_of(spark, [[("a", 1)], [], [("a", 2), (None, 1)]], shape, "updates"), path, session.fresh_path(spark, "state"), "key", ["version"])
    assert sorted((r.key or "", r.version) for r in Z.newest_version(spark, path).collect()) == [("", 1), ("a", 2)]


def test_first_records_by_state(spark):
    shape = "run string, step bigint, id bigint, loss double"
    batches = [[("a", 1, 5, 0.5), ("a", 1, 4, 0.4), ("a", 2, 6, 0.6)], [("a", 1, 1, 0.1), ("a", 3, 9, 0.9), ("a", 3, 8, 0.8)], [("b", 1, 0, 0.0), ("a", 2, 0, 0.0)]]
    path = session.fresh_path(spark, "first")
    query = Z.stream_first_per_step(batches_of(spark, batches, shape, "log"), path, session.fresh_path(spark, "state"), ["run", "step"], "id")
    got = sorted((r.batch, r.run, r.step, r.id, r.loss) for r in spark.read.parquet(path).collect())
    assert got == [(0, "a", 1, 4, 0.4), (0, "a", 2, 6, 0.6), (1, "a", 3, 8, 0.8), (2, "b", 1, 0, 0.0)]
    assert updated(query) == [2, 2, 2]


def test_first_records_write_state_of_their_batch_only(spark):
    shape = "run string, step bigint, id bigint"
    batches = [[("a", i, i) for i in range(300)]] + [[("a", 300 + b, b), ("a", b, b)] for b in range(9)]
    path = session.fresh_path(spark, "first")
    query = Z.stream_first_per_step(batches_of(spark, batches, shape, "log"), path, session.fresh_path(spark, "state"), ["run", "step"], "id")
    assert updated(query) == [300] + [2] * 9
    assert spark.read.parquet(path).count() == 309


def test_lines_of_split_files(spark, tmp_path):
    """Splits of a few bytes; lines end with a line feed, a carriage return, or both."""
    texts = {"a.log": "".join(f"line {i}{'\n' if i % 3 else '\r'}" for i in range(500)), "b.log": "one\r\ntwo\rthree\n\nfour", "c.log": "", "d.txt": "no"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = R.read_log_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {}
    for r in lines.collect():
        got.setdefault(os.path.basename(r.file), {})[r.line_no] = r.value
    assert got["a.log"] == {i: f"line {i}" for i in range(500)}
    assert got["b.log"] == dict(enumerate(["one", "two", "three", "", "four"])) and set(got) == {"a.log", "b.log"}


def test_split_at_the_cut_is_the_positional_split(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("is"))
    for ratio in (0.0, 0.5, 0.9, 0.999, 1.0):
        want = {r.id: r.is_val for r in S.positional_split(rows, ratio, 3, ["id"]).collect()}
        got = {r.id: r.is_val for r in S.split_at_ratio(rows, ratio, 3, ["id"]).collect()}
        assert got == want
    assert S.split_at_ratio(rows.limit(0), 0.9, 3, ["id"]).collect() == []


def test_the_split_moves_no_rows(spark):
    rows = spark.range(1000).select("id", F.lit("x").alias("text"))
    plan = S.split_at_ratio(rows, 0.9, 3, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
