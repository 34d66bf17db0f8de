"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyloom.functions import markers as M  # noqa: E402
from tallyloom.operators import token_rows as T  # noqa: E402
from tallyloom.operators.conversations import turn_markup  # noqa: E402
from tallyloom.queries import QUERIES  # noqa: E402
from tallyloom.queries.registry import spread  # noqa: E402
from tallyloom.session import build_session  # noqa: E402

HEADLINE = [
    "budget_select", "curate", "assistant_mask", "row_stats", "token_freq", "build_vocab", "encode", "draft_vocab",
    "exact_dedup", "length_quantiles", "class_hist", "vocab_coverage", "cross_entropy", "repeated_ngrams", "copy_shares",
    "ngram_hits", "contamination", "embed", "knn_topk", "round_robin_select", "pack_rows", "group_components",
    "mix_datasets", "exclude_ranges", "fingerprint_match", "parse_rendered", "splice_replies", "write_sharded",
    "counter_delta", "acceptance", "moving_average", "assemble_log_records", "stream_acceptance", "stream_ingest",
]
RUNS = 2


COPIES = 8


def masked_documents(spark, sf_dir):
    """Every document, eight times, as the reply of a rendered conversation, tokenised and masked."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text"))
    docs = docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(COPIES)))).drop("copy")
    text = F.concat(
        F.lit(M.BEGIN_TEXT), turn_markup(F.lit("user"), F.lit("go on")), turn_markup(F.lit("assistant"), F.col("text"))
    )
    rows = T.masked_rows(docs.withColumn("text", text), "id")
    return rows.agg(F.sum("n").alias("tokens"), F.sum(T.supervised(F.col("mask"))).alias("supervised"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["row_stats"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        best = None
        for _ in range(RUNS):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    best = None
    for _ in range(RUNS):
        t0 = time.perf_counter()
        tokens = masked_documents(spark, sf_dir).first().tokens
        took = time.perf_counter() - t0
        best = took if best is None else min(best, took)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, best of two runs, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "tokenise_mask_tokens_per_s": round(tokens / best),
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
