"""Readers. Schemas are explicit; Spark splits and prunes the files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions import markers as M
from ..functions.once import pinned
from ..session import lookup_join, settle


def read_rows(spark: SparkSession, path: str, cols: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*cols)


def read_union(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files with differing columns as one table, null where a file lacks a column."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines; a record ends only at a line feed, so other line separators inside text are kept."""
    return spark.read.schema(schema).json(path, lineSep="\n")


def read_json_array(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Files that hold one JSON array each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_log_lines(spark: SparkSession, root: str, pattern: str = "*.log") -> DataFrame:
    """Lines of log files with their numbers from 0: ``file, line_no, value``, as ``assemble_log_records`` takes them.

    A line ends at a line feed, at a carriage return (progress bars) or at both together. Files are split like any text: the
    lines are written once with their split and their place in the reading task, then numbered by the line counts of the
    splits before theirs, of which there is one row per split.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root)
    lines = settle(
        files.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("place"),
            "value",
        ),
        "lines",
    )
    splits = lines.groupBy("file", "split").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")
    numbered = lookup_join(lines, splits.select("file", "split", start.alias("shift")), ["file", "split"])
    return numbered.select("file", (F.col("place") + F.col("shift")).alias("line_no"), "value")


def attempt_messages(records: DataFrame) -> DataFrame:
    """Published trajectory records to ``task_name, messages`` with the usage beside each message.

    ``records``: ``task_name, attempts ARRAY<STRUCT<trajectory STRUCT<messages ARRAY<STRUCT<role, extra STRUCT<response
    STRUCT<usage>>>>>>>``. The messages of a task's attempts follow one another.
    """
    message = lambda m: F.struct(m["role"].alias("role"), m["extra"]["response"]["usage"].alias("usage"))
    given = F.filter("attempts", lambda a: a["trajectory"]["messages"].isNotNull())
    every = F.flatten(F.transform(given, lambda a: a["trajectory"]["messages"]))
    return records.select("task_name", F.transform(every, message).alias("messages"))


def explode_trajectories(tasks: DataFrame) -> DataFrame:
    """One row per assistant message with recorded usage: ``task, i, prompt_tokens, completion_tokens``.

    ``tasks``: ``task_name, messages ARRAY<STRUCT<role, usage STRUCT<prompt_tokens, completion_tokens>>>``, as read from
    (compressed) JSON lines.
    """
    messages = tasks.select(F.col("task_name").alias("task"), F.posexplode("messages").alias("i", "m"))
    return messages.filter((F.col("m.role") == "assistant") & (F.col("m.usage.prompt_tokens") > 0)).select(
        "task",
        "i",
        F.col("m.usage.prompt_tokens").alias("prompt_tokens"),
        F.col("m.usage.completion_tokens").alias("completion_tokens"),
    )


def read_trials(spark: SparkSession, root: str, schema: StructType | str, pattern: str, lines: bool = False) -> DataFrame:
    """A tree of JSON files, one document per file (or per line); the trial id is taken from the file's path by ``pattern``.

    A document that does not fit the schema stops the job.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("mode", "FAILFAST")
    files = reader.json(root, lineSep="\n") if lines else reader.json(root, multiLine=True)
    return with_path(files, files.columns).withColumn("trial", F.regexp_extract("path", pattern, 1)).drop("path")


def trial_steps(trials: DataFrame, steps: str = "steps") -> DataFrame:
    """One row per step of every trial: ``trial, step, s``."""
    return trials.select("trial", F.posexplode(steps).alias("step", "s"))


def with_path(files: DataFrame, keep: list[str]) -> DataFrame:
    """Add the ``path`` of a row's file.

    It is pinned: conditions on a file's path would otherwise be evaluated by the driver while it lists files, for several
    scans at once, where regular expressions share state and fail at random.
    """
    return pinned(files, {"path": F.col("_metadata.file_path")}, keep)


def unwrapped(text: str, field: str) -> Column:
    """A JSON number that may be wrapped as ``{"avg": x}`` or ``{"value": x}``."""
    return F.coalesce(
        F.get_json_object(text, f"$.{field}.avg"), F.get_json_object(text, f"$.{field}.value"), F.get_json_object(text, f"$.{field}")
    ).cast("double")


def record_pairs(text: str) -> Column:
    """``key, val`` of what loggers print as ``key=number``, parted by commas or white space; a number may be nan, inf or None."""
    parts = F.transform(F.split(text, r"[,\s]+"), lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substring(p, F.instr(p, "=") + 1, F.length(p)).alias("val")))

    def said(p):
        # A cast would also read the type letter of a Java number.
        number = p["val"].try_cast("double").isNotNull() & ~p["val"].rlike("[0-9.][dDfF]$")
        return p["key"].rlike(r"^[A-Za-z_][\w/]*$") & (p["key"] != p["val"]) & (number | (p["val"] == "None"))

    return F.filter(parts, said)


def read_results(spark: SparkSession, root: str, name: str, fields: list[str]) -> DataFrame:
    """Result tree ``<root>/<arm>/<benchmark>/<level>/seed<k>/<name>``: path parts and unwrapped metrics.

    ``name`` is a file pattern; folders may also be spelt ``arm=<arm>`` and so on, as partitioned writers do.
    """
    files = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    )
    parts = F.transform(F.split(F.col("path"), "/"), lambda p: F.substring_index(p, "=", -1))
    return with_path(files, ["value"]).select(
        F.element_at(parts, -5).alias("arm"),
        F.element_at(parts, -4).alias("benchmark"),
        F.element_at(parts, -3).alias("level"),
        F.regexp_extract(F.element_at(parts, -2), r"^(?:seed)?(\d+)$", 1).try_cast("int").alias("seed"),
        *[unwrapped("value", f).alias(f) for f in fields],
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("run"),
    )


def with_acceptance(spark: SparkSession, runs: DataFrame, root: str, name: str = "acceptance.csv") -> DataFrame:
    """Runs with the ``acceptance_length`` of the CSV table in their folder: of its row ``all``, or else of its first row.

    Tables may hold different columns in any order. A run without a table, or whose table has no such column, gets null.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    lines = F.transform(F.filter(F.split("value", r"\r?\n"), lambda x: F.trim(x) != ""), lambda x: F.split(x, ","))
    cell = lambda row, column: F.get(row, F.array_position(F.get("lines", 0), column).cast("int") - 1)
    rows = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    pooled = F.get(F.filter("rows", lambda r: cell(r, "subset") == "all"), 0)
    found = (
        with_path(files, ["value"])
        .select(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("run"), lines.alias("lines"))
        .withColumn("rows", rows)
        .withColumn("picked", F.coalesce(pooled, F.get("rows", 0)))
        .select("run", cell(F.col("picked"), "acceptance_length").try_cast("double").alias("acceptance_length"))
    )
    return runs.join(found, "run", "left")


def successful_runs(spark: SparkSession, runs: DataFrame, root: str, name: str = "status") -> DataFrame:
    """Runs whose status file, in the same folder, says ``exit=0``."""
    status = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True)
    )
    good = with_path(status, ["value"]).filter(F.col("value").rlike(r"^\s*exit=0\s*$")).select(
        F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("run")
    )
    return runs.join(good, "run", "left_semi")


def parse_metrics(lines: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Metric text lines to counters summed over label sets: ``<by>, name, position, total``.

    Comment lines are skipped, the ``_total`` suffix is removed, the ``position`` label is kept apart.
    """
    line = F.trim(value)
    pattern = M.METRIC_LINE
    parsed = lines.filter(line.rlike(pattern)).select(
        *by,
        F.regexp_replace(F.regexp_extract(line, pattern, 1), "_total$", "").alias("name"),
        F.nullif(F.regexp_extract(F.regexp_extract(line, pattern, 2), M.METRIC_POSITION, 1), F.lit(""))
        .cast("int")
        .alias("position"),
        F.regexp_replace(F.regexp_extract(line, pattern, 3), "Inf", "Infinity").try_cast("double").alias("x"),
    )
    return parsed.groupBy(*by, "name", "position").agg(F.sum("x").alias("total"))


def parse_log_windows(lines: DataFrame, by: list[str], k: int | None = None, value: str = "value") -> DataFrame:
    """Acceptance windows in free-form server logs: ``accepted, drafts, rates``; drafts = drafted tokens / k."""
    pattern = M.ACCEPTANCE_WINDOW
    rates = F.transform(F.split(F.regexp_extract(value, pattern, 4), ","), lambda x: F.trim(x).try_cast("double"))
    found = lines.filter(F.col(value).rlike(pattern)).select(
        *by,
        F.regexp_extract(value, pattern, 2).cast("bigint").alias("accepted"),
        F.regexp_extract(value, pattern, 3).cast("bigint").alias("drafted"),
        rates.alias("rates"),
    )
    size = F.lit(k) if k else F.size("rates")
    return found.withColumn("drafts", F.col("drafted") / size).filter("drafts > 0").drop("drafted")


def assemble_log_records(lines: DataFrame, step_key: str = "global_step") -> DataFrame:
    """Multi-line log records to one key/value map per step.

    ``lines``: ``file, line_no, value``. A record starts at an INFO line and ends at the continuation line with the step
    key; other processes' lines in between are ignored. Columns: ``file, block, first_line, step, fields, complete``. A
    file is one ordered stream of lines; its records are numbered by running counts inside line slices, and a record's
    lines are reduced to its last value per key before they meet, so neither a long file nor a long record is walked by
    one task.
    """
    from ..operators.ordering import total_before

    clean = pinned(lines, {"c": F.regexp_replace("value", M.ANSI_CODE, "")}, ["file", "line_no"])
    parts = pinned(
        clean, {"head": F.regexp_extract("c", M.RECORD_START, 1), "tail": F.regexp_extract("c", M.RECORD_LINE, 1)}, ["file", "line_no"]
    )
    is_start = F.col("head").rlike(M.RECORD_PREFIXES)
    closes = ~is_start & F.col("tail").rlike(rf"(?:^|[\s,]){step_key}=\d+$")
    marked = parts.filter(is_start | (F.col("tail") != "")).select(
        "file",
        "line_no",
        F.when(is_start, F.col("head")).otherwise(F.col("tail")).alias("piece"),
        is_start.cast("bigint").alias("is_start"),
        closes.alias("closes"),
    )
    blocks = (
        total_before(marked, ["file"], ["line_no"], F.floor(F.col("line_no") / 100_000), "is_start", "earlier")
        .withColumn("block", F.col("earlier") + F.col("is_start"))
        .filter("block > 0")
        .select("file", "block", "line_no", "piece", "closes")
    )
    blocks = settle(blocks, "log")
    ends = blocks.groupBy("file", "block").agg(
        F.min("line_no").alias("first_line"), F.min(F.when(F.col("closes"), F.col("line_no"))).alias("closed_at")
    )
    said = (
        blocks.join(ends.filter("closed_at IS NOT NULL").select("file", "block", "closed_at"), ["file", "block"])
        .filter(F.col("line_no") <= F.col("closed_at"))
        .select("file", "block", "line_no", F.posexplode(record_pairs("piece")).alias("i", "p"))
    )
    # A key said twice keeps its last value.
    last = said.groupBy("file", "block", "p.key").agg(F.max(F.struct("line_no", "i", "p.val")).alias("m"))
    fields = last.groupBy("file", "block").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "m.val"))).alias("fields")
    )
    return ends.join(fields, ["file", "block"], "left").select(
        "file",
        "block",
        "first_line",
        F.try_element_at("fields", F.lit(step_key)).try_cast("bigint").alias("step"),
        "fields",
        F.col("closed_at").isNotNull().alias("complete"),
    )


def log_anomalies(records: DataFrame) -> DataFrame:
    """Per file: records kept, truncated blocks, duplicate steps, records whose keys differ from the first record's.

    A block is truncated when the next one starts before it is closed; an open block at the end of the file is not.
    """
    done = records.filter("complete")
    names = F.array_join(F.array_sort(F.map_keys("fields")), ",")
    first = done.groupBy("file").agg(F.min(F.struct("first_line", names.alias("k"))).alias("f"))
    per_file = (
        done.withColumn("k", names)
        .join(first, "file")
        .groupBy("file")
        .agg(
            F.count_distinct("step").alias("kept"),
            (F.count("*") - F.count_distinct("step")).alias("duplicate_steps"),
            F.count_if(F.col("k") != F.col("f.k")).alias("missing_keys"),
        )
    )
    cut = (
        records.groupBy("file")
        .agg(F.count_if(~F.col("complete")).alias("open_blocks"), F.max(F.struct("block", "complete")).alias("last"))
        .select("file", (F.col("open_blocks") - F.when(F.col("last.complete"), 0).otherwise(1)).alias("truncated_blocks"))
    )
    return cut.join(per_file, "file", "left")


def load_mix(spark: SparkSession, spec: str | dict, known: DataFrame | None = None) -> DataFrame:
    """Mix specification (JSON text or dict with ``allocations_tokens``) to ``source, allocated``.

    Sources unknown to ``known`` stop the job.
    """
    allocations = (json.loads(spec) if isinstance(spec, str) else spec)["allocations_tokens"]
    mix = spark.createDataFrame([(k, int(v)) for k, v in sorted(allocations.items())], "source string, allocated bigint")
    if known is not None:
        unknown = [r.source for r in mix.join(known.select("source").distinct(), "source", "left_anti").limit(5).collect()]
        if unknown:
            raise ValueError(f"not in the data: {unknown}")
    return mix


def mix_from_column(specs: DataFrame, spec: str) -> DataFrame:
    """Mix specifications kept as JSON text in a column, to one row per source."""
    parsed = specs.select(F.from_json(F.get_json_object(spec, "$.allocations_tokens"), "map<string,bigint>").alias("m"))
    return parsed.select(F.explode("m").alias("source", "allocated"))
