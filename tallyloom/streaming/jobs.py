"""Structured Streaming jobs. Each takes a streaming DataFrame and returns one, or writes through a sink it names.

Late data: rows older than the watermark (10 minutes by default) are dropped; a window is emitted once, when the
watermark passes its end.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..session import fresh_path

LATE = "10 minutes"


# Keyed state on local disk of the executors; a checkpoint gets the changes of a batch, not the whole state.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Streams that are started inside keep their state as ``STATE_STORE`` says."""
    before = {name: spark.conf.get(name, None) for name in STATE_STORE}
    for name, value in STATE_STORE.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there now into Parquet, exactly once per checkpoint, and stop."""
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over the files present and read its output back from the shared folder."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    run_available(stream, path, fresh_path(spark, name + "-state"))
    return spark.read.schema(stream.schema).parquet(path)


def drain_batches(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run an update-mode stream; every batch is appended with its number and the newest row per key is read back."""
    from ..operators.selection import latest_per_key

    spark = stream.sparkSession
    path = fresh_path(spark, name)

    def append(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(append)
        .option("checkpointLocation", fresh_path(spark, name + "-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(path)
    packed = rows.withColumn("__key", F.struct(*keys)).drop(*keys)
    newest = latest_per_key(packed, "__key", ["__batch"])
    return newest.select("__key.*", *[c for c in packed.columns if c not in ("__key", "__batch")])


def stream_acceptance(log: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Accepted length and throughput per window and arm; failed batches are skipped.

    ``log``: ``ts, arm, ok, drafts, accepted, tokens, seconds``.
    """
    return (
        log.filter("ok")
        .withWatermark("ts", late)
        .groupBy(F.window("ts", width), "arm")
        .agg(
            F.count("*").alias("batches"),
            (1 + F.sum("accepted") / F.sum("drafts")).alias("acceptance_length"),
            (F.sum("tokens") / F.sum("seconds")).alias("tokens_per_s"),
        )
        .select(
            F.unix_timestamp(F.col("window.start")).alias("window_start"), "arm", "batches", "acceptance_length", "tokens_per_s"
        )
    )


# ---- a table of the newest row per key -------------------------------------------------------------------------------

# Parts of the table by the hash of the key; more of them for larger tables.
PARTS = 16


def _runs(spark: SparkSession, path: str, number: int) -> list:
    """The runs that made up the table after a batch: ``part, run, n``; at most a few for each of PARTS parts."""
    return [] if number < 0 else spark.read.schema("part int, run bigint, n bigint").parquet(f"{path}/manifest/v={number}").collect()


def _read_runs(spark: SparkSession, path: str, runs: list, shape: StructType) -> DataFrame | None:
    """Rows of some runs; of a run only the folders of the parts that are asked for are read."""
    if not runs:
        return None
    folders = [f"{path}/data/run={r.run}/part={r.part}" for r in runs]
    return spark.read.schema(shape).option("basePath", f"{path}/data").parquet(*folders)


def _merge(batch: DataFrame, path: str, number: int, key: str, order: list[str], parts: int) -> None:
    """Merge a batch into the table at ``path`` and write the manifest of the batch."""
    from ..operators.selection import latest_per_key

    spark, shape = batch.sparkSession, batch.schema
    of_part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
    batch = batch.withColumn("part", of_part)
    arrived = {r.part: r.n for r in batch.groupBy("part").agg(F.count("*").alias("n")).collect()}
    kept, merged = [], []
    by_part: dict[int, list] = {}
    for r in sorted(_runs(spark, path, number - 1), key=lambda r: (r.part, r.run)):
        by_part.setdefault(r.part, []).append(r)
    for part, runs in by_part.items():
        size = arrived.get(part, 0)
        while size and runs and runs[-1].n < 2 * size:
            size += runs[-1].n
            merged.append(runs.pop())
        kept += runs
    known = _read_runs(spark, path, merged, shape)
    both = batch if known is None else batch.unionByName(known.select(*shape.fieldNames()).withColumn("part", of_part))
    newest = latest_per_key(both, key, order).select(*shape.fieldNames(), of_part.alias("part"))
    written = []
    if arrived:
        run = f"{path}/data/run={number}"
        newest.write.mode("overwrite").partitionBy("part").parquet(run)
        back = spark.read.schema(f"{shape.toDDL()}, part int").parquet(run)
        written = [(r.part, number, r.n) for r in back.groupBy("part").agg(F.count("*").alias("n")).collect()]
    rows = [(r.part, r.run, r.n) for r in kept] + written
    spark.createDataFrame(rows, "part int, run bigint, n bigint").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/v={number}")
    seen = spark.createDataFrame([(sum(arrived.values()), key, order, shape.json())], "n bigint, key string, order array<string>, shape string")
    seen.coalesce(1).write.mode("overwrite").parquet(f"{path}/updates/v={number}")


def stream_latest(updates: DataFrame, path: str, checkpoint: str, key: str, order: list[str], parts: int = PARTS) -> None:
    """Newest update per key as a table of sorted-out runs; older pending updates are superseded.

    The table is dealt to ``parts`` by the hash of the key. A batch adds one run to the parts that it has keys of; all other
    parts keep their files. A part's newest runs are merged with what comes in while they are not at least twice its size, so
    a part has few runs and a row is rewritten a few times over the table's life, not with every batch. The manifest of a
    batch names the runs of every part; a repeated batch starts from the manifest before it and writes the same.
    """
    query = (
        updates.writeStream.foreachBatch(lambda batch, number: _merge(batch, path, number, key, order, parts))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("n bigint, key string, order array<string>, shape string, v bigint").parquet(f"{path}/updates")


def superseded(spark: SparkSession, path: str) -> int:
    """Updates that a newer one of the same key replaced, over all batches of ``stream_latest``."""
    return _updates(spark, path).agg(F.sum("n").alias("n")).first().n - newest_version(spark, path).count()


def newest_version(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``stream_latest`` keeps at ``path``: the newest row per key over the runs of its newest manifest."""
    from ..operators.selection import latest_per_key

    last = _updates(spark, path).orderBy(F.desc("v")).first()
    shape = StructType.fromJson(json.loads(last["shape"]))
    rows = _read_runs(spark, path, _runs(spark, path, last.v), shape)
    rows = spark.createDataFrame([], shape) if rows is None else rows.select(*shape.fieldNames())
    return latest_per_key(rows, last.key, list(last.order)).select(*shape.fieldNames())


def stream_counter_delta(scrapes: DataFrame, path: str, checkpoint: str, scrapes_per_slice: int = 1000, parts: int = PARTS) -> None:
    """Increment of every counter since its scrape before, tolerant of resets, written to ``<path>/deltas``.

    ``scrapes``: ``engine, name, scrape bigint, value``. The state is the last scrape of every counter, a table as
    ``stream_latest`` keeps it at ``<path>/state``: a batch reads the parts that its counters are in and writes a run of its
    own counters, so what it costs depends on the batch and the number of counters, not on the scrapes before. A batch is
    joined to the state like an ordinary table, so one busy engine is not walked by one task. A scrape that is not newer than
    the last known of its counter has no increment and changes no state. A repeated batch writes the same files.
    """
    from ..operators.evaluation import counter_delta
    from ..operators.selection import latest_per_key

    spark = scrapes.sparkSession
    columns = ["engine", "name", "scrape", "value"]

    def step(batch: DataFrame, number: int) -> None:
        fresh = batch.select(*columns).withColumn("__key", F.struct("engine", "name"))
        rows = fresh.select("__key", "scrape", "value")
        of_part = F.pmod(F.xxhash64("__key"), F.lit(parts)).cast("int")
        touched = {r.part for r in rows.select(of_part.alias("part")).distinct().collect()}
        known = _read_runs(spark, f"{path}/state", [r for r in _runs(spark, f"{path}/state", number - 1) if r.part in touched], rows.schema)
        both = fresh.select(*columns, F.lit(True).alias("fresh"))
        if known is not None:
            asked = known.join(rows.select("__key").distinct(), "__key", "left_semi")
            last = latest_per_key(asked.select("__key", "scrape", "value"), "__key", ["scrape"])
            both = both.unionByName(last.select("__key.*", "scrape", "value", F.lit(False).alias("fresh")))
        deltas = counter_delta(both, F.floor(F.col("scrape") / scrapes_per_slice)).filter("fresh").drop("fresh")
        deltas.write.mode("overwrite").parquet(f"{path}/deltas/batch={number}")
        _merge(rows, f"{path}/state", number, "__key", ["scrape"], parts)

    query = scrapes.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def stream_first_per_step(log: DataFrame, path: str, checkpoint: str, key: list[str], order: str) -> StreamingQuery:
    """First record per step of a log that repeats steps after a restart, appended to ``path``.

    Inside a batch the smallest ``order`` wins; a step written by an earlier batch is not written again. Keyed state holds one
    row per step with the times of the first and the last batch that had it: a step is new where the two are equal. A batch
    reads and writes the state of its own steps and nothing of earlier output; a repeated batch has the time it had before.
    """
    others = [c for c in log.columns if c not in key and c != order]
    # Within a batch the time stands still.
    steps = log.withColumn("__at", F.current_timestamp()).groupBy(*key).agg(
        F.min(F.struct(order, *others)).alias("__first"), F.min("__at").alias("__since"), F.max("__at").alias("__last")
    )

    def write(batch: DataFrame, number: int) -> None:
        new = batch.filter(F.col("__since") == F.col("__last"))
        columns = [F.col(c) if c in key else F.col(f"__first.{c}").alias(c) for c in log.columns]
        new.select(*columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    with keyed_state(log.sparkSession):
        writer = steps.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def drop_repeats(log: DataFrame, key: list[str], late: str = LATE) -> DataFrame:
    """The bounded-state form: repeats within the watermark's reach are dropped, whichever of them came first."""
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark(key)


def stream_exclude(prompts: DataFrame, held: DataFrame, key: str, low: int, high: int, length: str = "n") -> DataFrame:
    """Prompt feed without held-out keys and over-long prompts. ``held`` is a static table."""
    fits = prompts.filter((F.col(length) >= low) & (F.col(length) <= high))
    return fits.join(held.select(key), key, "left_anti")


def stream_ingest(
    spark: SparkSession,
    folder: str,
    schema: StructType,
    make: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    files_per_batch: int = 100,
) -> None:
    """New Parquet files of a folder through a row-local transformation (tokens, statistics), appended to ``path``.

    At most ``files_per_batch`` files make a batch, so a backlog is taken in steps; the checkpoint makes it exactly once.
    """
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    run_available(make(files), path, checkpoint)


def stream_curve(log: DataFrame, width: int) -> DataFrame:
    """Mean accepted length per arm and request bin, updated as records arrive. ``log``: ``arm, done, accept``."""
    return log.groupBy("arm", (F.ceil(F.col("done") / width) - 1).alias("bin")).agg(
        F.count("*").alias("n_rows"), F.avg("accept").alias("mean_accept")
    )
