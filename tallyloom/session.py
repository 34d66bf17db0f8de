"""Session settings, the shared folder, and size-checked joins."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when its written form has at most this many bytes and rows.
BROADCAST_BYTES = 16 * 2**20
BROADCAST_ROWS = 4_000_000
# When the lookup side is too big to broadcast: most frequent keys whose rows are spread, and over how many salts.
HOT_KEYS = 1000
SALTS = 32


def build_session(cores: str = "*", shuffle_partitions: int = 8, memory: str = "12g", shared: str | None = None) -> SparkSession:
    """Local session for tests and the benchmark, with its shared folder; a cluster supplies its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tallyloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        # Rows may hold long token arrays, so Arrow batches are kept short.
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", shared or tempfile.mkdtemp(prefix="tallyloom-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the session's checkpoint folder, or else a folder in its warehouse."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared")
    return sc.getCheckpointDir()


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives lost executors, and gives the optimizer the true size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more; Spark's cleaner drops the shuffles that led to it."""
    sc = df.sparkSession.sparkContext
    for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        if shared_dir(df.sparkSession).rstrip("/").rsplit("/", 1)[-1] == path.getParent().getName():
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    # The cleaner learns of unused shuffles when the driver's memory is collected.
    gc.collect()
    sc._jvm.System.gc()


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files that a settled table reads, as the planner knows them."""
    return int(str(df._jdf.queryExecution().analyzed().stats().sizeInBytes()))


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    keys: list[str],
    how: str = "inner",
    limit: int | None = None,
    settled: bool = False,
) -> DataFrame:
    """Join a large table, whose keys may be hot, with a table that has one row per key.

    ``small`` is written once and measured. While it has at most BROADCAST_BYTES bytes and ``limit`` rows it is broadcast, so
    the large side does not move. Beyond that both are shuffled, and the rows of the large side's most frequent keys are
    spread over SALTS salts, with their few lookup rows copied to each; no key left unsalted holds more than one in HOT_KEYS
    of the rows. Only the keys of the large side are read beforehand.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    side = small if settled else settle(small, "lookup")
    if written_bytes(side) <= BROADCAST_BYTES and side.count() <= (BROADCAST_ROWS if limit is None else limit):
        return big.join(F.broadcast(side), keys, how)
    counted = big.select(*keys).dropna().groupBy(*keys).agg(F.count("*").alias("__rows"))
    hot = settle(counted.orderBy(F.desc("__rows"), *keys).limit(HOT_KEYS).select(*keys, F.lit(1).alias("__hot")), "hot")
    # The salt follows the task that reads a row, so a repeated task salts alike.
    salt = F.when(F.col("__hot") == 1, F.pmod(F.spark_partition_id(), F.lit(SALTS))).otherwise(F.lit(0))
    spread = big.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__hot")
    copies = F.when(F.col("__hot") == 1, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    copied = side.join(F.broadcast(hot), keys, "left").withColumn("__salt", F.explode(copies)).drop("__hot")
    return spread.join(copied.hint("merge"), [*keys, "__salt"], how).drop("__salt")
