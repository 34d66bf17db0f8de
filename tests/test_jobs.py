"""Readers, streams and whole jobs on small hand-made files."""

import json

import pytest
import zstandard
from pyspark.sql import functions as F

from tallyloom import session
from tallyloom.functions import markers as M
from tallyloom.operators import conversations as V
from tallyloom.operators import token_rows as T
from tallyloom.plans import curation, decontaminate, evaluation, regenerate
from tallyloom.sources import readers as R
from tallyloom.sources import writers as K
from tallyloom.streaming import jobs as Z


def texts_of(spark, per_source=30):
    rows = [
        (c, f"s{c % 2}", t, "user" if t % 2 == 0 else "assistant", f"word{c} " * (c % 5 + 1 + t))
        for c in range(per_source * 2)
        for t in range(4)
    ]
    turns = spark.createDataFrame(rows, "conv_id bigint, source string, turn bigint, role string, text string")
    return V.render(turns, keep=["source"]).withColumnRenamed("conv_id", "id")


def test_curate_reconciles(spark):
    texts = texts_of(spark)
    mix = spark.createDataFrame([("s0", 300), ("s1", 200)], "source string, allocated bigint")
    path = session.fresh_path(spark, "test-curate")
    manifest = {r.source: r for r in curation.curate(texts, mix, path, 40, 200, 1).collect()}
    rows = spark.read.parquet(path + "/rows")
    assert rows.count() == manifest[None].rows_kept
    assert T.bad_rows(rows, 40).isEmpty()
    freq = spark.read.parquet(path + "/token_freq").agg(F.sum("cnt").alias("c")).first().c
    assert freq == manifest[None].tokens_supervised
    with pytest.raises(ValueError, match="refusing"):
        curation.curate(texts, mix.withColumn("allocated", F.lit(10**9)), path + "-big", 40, 200, 1)


def test_whole_source_is_taken(spark):
    texts = texts_of(spark)
    sizes = T.tokenize(texts).groupBy("source").agg(F.sum("n").alias("allocated"))
    path = session.fresh_path(spark, "test-whole")
    curation.curate(texts, sizes, path, 10_000, 10_000, 1)
    assert spark.read.parquet(path + "/rows").count() == 60


def test_sample_keeps_the_shares(spark):
    texts = texts_of(spark, 200)
    sizes = T.tokenize(texts).groupBy("source").agg(F.sum("n").alias("allocated"))
    path = session.fresh_path(spark, "test-sample")
    curation.curate(texts, sizes, path, 10_000, 10_000, 1, sample_rows=100)
    per_source = [r["count"] for r in spark.read.parquet(path + "/rows").groupBy("source").count().collect()]
    assert len(per_source) == 2 and all(40 <= n <= 60 for n in per_source)


def test_decontaminate(spark):
    words = [f"w{i}" for i in range(40)]
    problems = spark.createDataFrame([(1, words), (2, [f"x{i}" for i in range(40)]), (3, words[:5])], "item_id bigint, tokens array<string>")
    shape = "id bigint, tokens array<string>, mask array<tinyint>"
    clean = spark.createDataFrame([(0, ["a"] * 50, None)], shape)
    dirty = spark.createDataFrame([(0, ["a"] + words[:30], [0] * 31)], shape)
    kept = decontaminate.decontaminate(problems, {"clean": clean, "dirty": dirty})
    assert sorted(r.item_id for r in kept.collect()) == [2, 3]
    counts = decontaminate.decontamination_counts(problems.withColumn("set", F.lit("s")), kept, "set").first()
    assert (counts.rows_kept, counts.rows_dropped) == (2, 1)


def test_regenerate_stops_where_a_reply_is_cut(spark):
    texts = texts_of(spark, 3)
    rows = T.masked_rows(texts, "id")

    def reply(prompts, max_tokens, request_seeds):
        turns = [sum(t == "assistant" for t in prompt) for prompt in prompts]
        return [(["fine", M.END_TURN], "stop") if turn == 1 else (["cut"], "length") for turn in turns]

    parts = regenerate.regenerate(rows, reply, 10_000, 64, 1).collect()
    assert len(parts) == 6 and {p.status for p in parts} == {"capped"} and {p.n_regenerated for p in parts} == {2}
    assert all(p.tokens[-1] == "cut" for p in parts)


def test_regenerate_refuses_many_errors(spark):
    def broken(prompts, max_tokens, request_seeds):
        raise RuntimeError("no server")

    with pytest.raises(ValueError, match="failed"):
        regenerate.regenerate(T.masked_rows(texts_of(spark, 2), "id"), broken, 100, 10, 1, retries=0)


def test_zstd_lines_with_line_separators(spark, tmp_path):
    record = {"task_name": "t", "messages": [
        {"role": "user"},
        {"role": "assistant", "usage": {"prompt_tokens": 5, "completion_tokens": 2}, "text": "a b"},
        {"role": "assistant"},
    ]}
    body = (json.dumps(record, ensure_ascii=False) + "\n").encode()
    (tmp_path / "x.jsonl.zst").write_bytes(zstandard.compress(body * 3))
    shape = "task_name string, messages array<struct<role:string,usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>"
    out = R.explode_trajectories(R.read_jsonl(spark, str(tmp_path), shape)).collect()
    assert [(r.task, r.i, r.prompt_tokens, r.completion_tokens) for r in out] == [("t", 1, 5, 2)] * 3


def test_result_tree_and_speedup(spark, tmp_path):
    for arm, tokens, status in (("plain-a", 100, "exit=0"), ("a", 250, "exit=0\n"), ("b", 1, "exit=1"), ("plain-b", 1, "exit=0")):
        run = tmp_path / arm / "mix" / "c16" / "seed0"
        run.mkdir(parents=True)
        (run / "results.json").write_text(json.dumps({"output_tokens": {"avg": tokens}, "wall_s": 10}))
        (run / "status").write_text(status)
    report = evaluation.speedup_report(spark, str(tmp_path), "results.json", "status").collect()
    assert [(r.arm, r.speedup) for r in report] == [("a", 2.5)]


def test_two_scrapes(spark):
    def scrape(label, drafts, accepted):
        lines = [
            "# HELP x", f'eng:spec_decode_num_drafts_total{{engine="0"}} {drafts}', f'eng:spec_decode_num_drafts_total{{engine="1"}} {drafts}',
            f'eng:spec_decode_num_accepted_tokens_total{{engine="0"}} {accepted}', f'eng:spec_decode_num_draft_tokens_total{{engine="0"}} {drafts * 8}',
            "broken line",
        ]
        return R.parse_metrics(spark.createDataFrame([(label, x) for x in lines], "subset string, value string"), ["subset"])

    out = {r.subset: r for r in evaluation.acceptance_from_scrapes(scrape("s", 10, 5), scrape("s", 30, 45)).collect()}
    assert out["s"].drafts == 40 and out["s"].acceptance_length == 2.0 and out["all"].accepted_tokens == 40


def test_mix_rejects_unknown_sources(spark):
    known = spark.createDataFrame([("a",)], "source string")
    spec = json.dumps({"allocations_tokens": {"a": 5, "b": 6}})
    with pytest.raises(ValueError, match="not in the data"):
        R.load_mix(spark, spec, known)
    assert R.load_mix(spark, spec).count() == 2


def test_leaking_prompts_are_refused(spark):
    prompts = spark.createDataFrame([(1, 1, "first", 5)], "conv_id bigint, turn bigint, turn_kind string, prompt_tokens bigint")
    with pytest.raises(ValueError, match="both sides"):
        K.write_prompt_set(prompts, session.fresh_path(spark, "leak"), ["conv_id"], prompts, ["conv_id"])


def write_batch(spark, path, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)


def test_late_rows_are_dropped(spark):
    shape = "ts timestamp, arm string, ok boolean, drafts bigint, accepted bigint, tokens bigint, seconds bigint"
    path, out, state = (session.fresh_path(spark, n) for n in ("late-in", "late-out", "late-state"))

    def row(minute, tokens):
        from datetime import datetime, timedelta

        return (datetime(2024, 1, 1) + timedelta(minutes=minute), "a", True, 1, 1, tokens, 1)

    stream = lambda: Z.stream_acceptance(spark.readStream.schema(shape).parquet(path))
    write_batch(spark, path, [row(5, 1), row(59, 2)], shape)
    Z.run_available(stream(), out, state)
    write_batch(spark, path, [row(130, 4)], shape)
    Z.run_available(stream(), out, state)
    write_batch(spark, path, [row(10, 100), row(200, 8)], shape)  # minute 10 is long past the watermark
    Z.run_available(stream(), out, state)
    done = {r.window_start % 86400 // 3600: r.batches for r in spark.read.parquet(out).collect()}
    assert done == {0: 2, 2: 1}


def test_ingest_is_exactly_once(spark):
    shape = "id bigint, text string"
    path, out, state = (session.fresh_path(spark, n) for n in ("in", "out", "state"))
    make = lambda t: T.tokenize(t).select("id", "n")
    for batch in ([(1, "a b")], [(2, "c")], []):
        if batch:
            write_batch(spark, path, batch, shape)
        Z.stream_ingest(spark, path, spark.createDataFrame([], shape).schema, make, out, state, files_per_batch=1)
    assert sorted((r.id, r.n) for r in spark.read.parquet(out).collect()) == [(1, 2), (2, 1)]


def test_stream_deltas_carry_over_batches_and_resets(spark):
    shape = "engine string, name string, scrape bigint, value double"
    path, out, state = (session.fresh_path(spark, n) for n in ("c-in", "c-out", "c-state"))
    for batch in ([("e", "c", 0, 5.0), ("e", "c", 1, 9.0)], [("e", "c", 2, 2.0), ("f", "c", 2, 1.0)], [("e", "c", 3, 2.5)]):
        write_batch(spark, path, batch, shape)
        Z.stream_counter_delta(spark.readStream.schema(shape).parquet(path), out, state)
    got = sorted((r.engine, r.scrape, r.delta) for r in spark.read.parquet(out + "/deltas").fillna(-1.0).collect())
    assert got == [("e", 0, -1.0), ("e", 1, 4.0), ("e", 2, 2.0), ("e", 3, 0.5), ("f", 2, -1.0)]


def test_newest_update_wins(spark):
    shape = "key string, step bigint, body string"
    path, out, state = (session.fresh_path(spark, n) for n in ("l-in", "l-out", "l-state"))
    for batch in ([("a", 2, "new"), ("a", 1, "old"), ("b", 1, "x")], [("a", 1, "late")], [("b", 5, "y")]):
        write_batch(spark, path, batch, shape)
        Z.stream_latest(spark.readStream.schema(shape).parquet(path), out, state, "key", ["step"])
    assert sorted((r.key, r.body) for r in Z.newest_version(spark, out).collect()) == [("a", "new"), ("b", "y")]


def test_log_records(spark):
    pad = " " * 20
    lines = [
        "[10:00:00] INFO     train/loss=0.5,     trainer.py:569", pad + "lr/a=1e-3, global_step=1", pad + "late=9, global_step=7",
        "[10:00:01] INFO     train/loss=0.4,     trainer.py:569", "noise",
        "[10:00:02] INFO     train/loss=0.3,     trainer.py:569", pad + "x=None", pad + "lr/a=2, global_step=1",
        "[10:00:03] INFO     other message       trainer.py:570",
        "[10:00:04] INFO     train/loss=0.2,     trainer.py:569",
    ]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(lines)], "file string, line_no bigint, value string")
    records = R.assemble_log_records(df)
    got = sorted((r.step, r.fields["train/loss"], "late" in r.fields) for r in records.filter("complete").collect())
    assert got == [(1, "0.3", False), (1, "0.5", False)]
    a = R.log_anomalies(records).first()
    assert (a.kept, a.truncated_blocks, a.duplicate_steps, a.missing_keys) == (1, 1, 1, 1)


def test_superseded_updates_are_counted(spark):
    from tallyloom.session import fresh_path
    from tallyloom.streaming import jobs as Z

    folder, path = fresh_path(spark, "updates"), fresh_path(spark, "latest")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("a", 3), ("b", 0)], "key string, version int").repartition(3)
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    Z.stream_latest(stream, path, fresh_path(spark, "latest-state"), "key", ["version"])
    assert sorted(map(tuple, Z.newest_version(spark, path).collect())) == [("a", 3), ("b", 1)]
    assert Z.superseded(spark, path) == 3


def test_flagged_share_per_set(spark):
    from tallyloom.operators import contamination as N

    summary = spark.createDataFrame([(1, 0.7), (2, 0.1), (3, 0.5)], "item_id bigint, best double")
    sets = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "b"), (5, "c")], "item_id bigint, set string")
    got = {r["set"]: (r.n_items, r.n_tested, r.n_flagged, r.share) for r in N.flagged_share(summary, sets).collect()}
    assert got == {"a": (2, 2, 1, 0.5), "b": (2, 1, 1, 1.0), "c": (1, 0, 0, None)}


def test_rates_by_position_from_scrapes(spark):
    from tallyloom.plans.evaluation import acceptance_from_scrapes

    shape = "subset string, name string, position bigint, total double"
    names = ["drafts", "draft_tokens", "accepted_tokens"]
    rows = [("s", f"srv:spec_decode_num_{n}", None, v) for n, v in zip(names, (10.0, 20.0, 12.0))]
    rows += [("s", "srv:spec_decode_num_accepted_tokens_per_pos", i, v) for i, v in ((0, 8.0), (1, 4.0))]
    before = spark.createDataFrame([r[:3] + (0.0,) for r in rows], shape)
    got = acceptance_from_scrapes(before, spark.createDataFrame(rows, shape), positions=2).filter("subset = 's'").first()
    assert (got.acceptance_length, got.acceptance_at_pos_0, got.acceptance_at_pos_1) == (2.2, 0.8, 0.4)


def test_log_lines_have_numbers(spark, tmp_path):
    from tallyloom.sources.readers import read_log_lines

    (tmp_path / "a.log").write_text("one\n\nthree")
    (tmp_path / "b.txt").write_text("no")
    rows = read_log_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r.line_no, r.value) for r in rows] == [(0, "one"), (1, ""), (2, "three")] and rows[0].file.endswith("a.log")


def test_published_trajectories(spark, tmp_path):
    from tallyloom.sources import readers as R

    usage = {"prompt_tokens": 7, "completion_tokens": 3}
    message = {"role": "assistant", "extra": {"response": {"usage": usage}}}
    record = {"task_name": "t", "attempts": [{"trajectory": {"messages": [{"role": "user"}, message]}}, {"trajectory": None}, {"trajectory": {"messages": [message]}}]}
    (tmp_path / "x.jsonl").write_text(json.dumps(record) + "\n")
    schema = ("task_name string, attempts array<struct<trajectory:struct<messages:array<struct<role:string,extra:struct<response:"
              "struct<usage:struct<prompt_tokens:bigint,completion_tokens:bigint>>>>>>>>")  # fmt: skip
    rows = R.explode_trajectories(R.attempt_messages(R.read_jsonl(spark, str(tmp_path), schema))).collect()
    assert sorted((r.task, r.i, r.prompt_tokens, r.completion_tokens) for r in rows) == [("t", 1, 7, 3), ("t", 2, 7, 3)]


def test_counters_of_a_write(spark):
    """Counted while writing: rows of all shards and of none, and a row that breaks an invariant."""
    rows = spark.range(50).selectExpr("id", "array(id, id) AS tokens", "array(0, if(id = 7, 0, 1)) AS mask", "2 AS n")
    counters = {"kept": F.count(F.lit(1)), "bad": F.count_if(~T.sound(2))}
    assert K.write_sharded(rows, session.fresh_path(spark, "counted"), 4, 1, counters=counters) == {"kept": 50, "bad": 1}
    empty = rows.filter("id < 0")
    assert K.write_sharded(empty, session.fresh_path(spark, "counted"), 4, 1, counters=counters) == {"kept": 0, "bad": 0}
    assert K.write_sharded(rows, session.fresh_path(spark, "counted"), 4, 1) == {}
