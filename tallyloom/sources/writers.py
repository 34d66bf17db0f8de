"""Writers. Nothing is ever overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.seeded import key_bucket, order_key


def shard_columns(rows: DataFrame, n: int, seed: int, key: str = "id") -> DataFrame:
    """``shard`` from the first hash digits of the id, and ``h``, the seeded order inside the shard."""
    named = rows.withColumn("shard", key_bucket(F.md5(F.col(key).cast("string")), n).cast("int"))
    return named.withColumn("h", order_key(seed, "shard", key))


def shard_count(tokens: int, shard_tokens: int) -> int:
    return max(1, -(-tokens // shard_tokens))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a write below ``path`` was committed: Spark marks it with a ``_SUCCESS`` file."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


# A task writes at most so many shards, one after the other, once there are more shards than shuffle partitions.
TASK_SHARDS = 16


def write_sharded(
    rows: DataFrame, path: str, n: int, seed: int, key: str = "id", resume: bool = False, counters: dict[str, Column] | None = None
) -> dict:
    """One folder per shard, rows in seeded order, every source in proportion in every shard.

    One shuffle straight into a partition for each run of shards: one shard, or ``TASK_SHARDS`` at most when shards outnumber
    the session's shuffle partitions, so the tasks, each of which reports to the driver, are far fewer than the shards. A
    shard's rows are one sorted file, whose size the caller sets through ``n`` (see ``shard_count``). With ``resume`` what an
    unfinished run left at ``path`` is replaced.

    ``counters`` are aggregates over the rows, returned by name. They are taken in the tasks that write, behind the shuffle, so
    the shards are not read again and a task that is repeated counts once.
    """
    at_least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    run = min(TASK_SHARDS, max(1, -(-n // at_least)))
    dealt = shard_columns(rows, n, seed, key).repartitionById(-(-n // run), F.floor(F.col("shard") / run).cast("int"))
    placed = dealt.sortWithinPartitions("shard", "h", key)
    seen = Observation()
    if counters:
        placed = placed.observe(seen, *[c.alias(name) for name, c in counters.items()])
    (
        placed.write.mode("overwrite" if resume else "errorifexists")
        .partitionBy("shard")
        .parquet(path)
    )
    return seen.get if counters else {}


def safe_write(rows: DataFrame, path: str, inputs: list[str] | None = None) -> None:
    """Write Parquet; refuse an existing output or one inside an input."""
    for source in inputs or []:
        inside = path.rstrip("/") + "/"
        if inside.startswith(source.rstrip("/") + "/"):
            raise ValueError(f"refusing: {path} is inside the input {source}")
    rows.write.mode("errorifexists").parquet(path)


def manifest(rows: DataFrame, seed: int, length: int, partial: bool = False) -> DataFrame:
    """Per source and in total (source null): rows, tokens, supervised tokens, with the run's settings.

    ``rows``: ``source, n, n_supervised``.
    """
    return rows.rollup("source").agg(
        F.count("*").alias("rows_kept"), F.sum("n").alias("tokens_kept"), F.sum("n_supervised").alias("tokens_supervised")
    ).select(
        "*", F.lit(seed).alias("seed"), F.lit(length).alias("seq_length"), F.lit(partial).alias("partial")
    )


def write_manifest(rows: DataFrame, path: str, **settings) -> None:
    manifest(rows, **settings).coalesce(1).write.mode("errorifexists").json(path)


def write_token_freq(rows: DataFrame, path: str) -> None:
    from ..operators.token_rows import token_freq

    token_freq(rows).write.mode("errorifexists").parquet(path)


def prompt_manifest(prompts: DataFrame, keys: list[str], by: str = "turn_kind", length: str = "prompt_tokens") -> DataFrame:
    """Per prompt file: count, order-independent content checksum, nearest-rank median and longest prompt."""
    from ..operators.aggregates import length_quantiles

    # Digits of the md5 of every line, summed exactly: the same whatever the order or partitioning.
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), 1, 12), 16, 10)
    sums = prompts.groupBy(by).agg(F.sum(digits.cast("decimal(38,0)")).cast("string").alias("checksum"))
    return length_quantiles(prompts, [], [by], length).join(sums, by)


def turn_histogram(prompts: DataFrame, by: str = "turn_kind", turn: str = "assistant_turn") -> DataFrame:
    return prompts.groupBy(by, turn).agg(F.count("*").alias("n_prompts"))


def write_prompt_set(prompts: DataFrame, path: str, keys: list[str], held: DataFrame, held_keys: list[str]) -> None:
    """JSON lines plus manifest; a prompt whose key is in the training sample stops the write.

    The manifest has a row per file with the histogram of its turns and the number of keys shared with the sample, 0.
    """
    from ..operators.sets import require_no_overlap

    shared = require_no_overlap(prompts, held, held_keys)
    prompts.write.mode("errorifexists").partitionBy("turn_kind").json(path + "/prompts")
    turns = F.sort_array(F.collect_list(F.struct("assistant_turn", "n_prompts")))
    histogram = turn_histogram(prompts).groupBy("turn_kind").agg(turns.alias("turn_histogram"))
    described = prompt_manifest(prompts, keys).join(histogram, "turn_kind").withColumn("train_overlap", F.lit(shared))
    described.coalesce(1).write.mode("errorifexists").json(path + "/manifest")


def write_report(table: DataFrame, path: str) -> None:
    """A finished report (few rows) as one CSV file with a header."""
    table.coalesce(1).write.mode("errorifexists").csv(path, header=True)
