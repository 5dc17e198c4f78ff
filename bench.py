"""Seconds of the headline queries at $BENCH_SF_DIR (default sf0.1) on local[$BENCH_CPUS]: one JSON line.

Each query's whole result is computed, without being written or fetched, once to warm up and then timed. probe is the time
of a fixed amount of hashing on the same machine, by which figures of different runs compare.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from lodestone.plans import corpus, live, retrieval

HEADLINE = ["topk_chunks", "retrieve_packed", "sources", "render_prompt", "index_build", "content_length_enrich", "graph_edges", "align_consolidate", "preprocess", "delete_chunk_merge", "response_events", "active_requests", "power_totals", "session_windows", "prefix_first_match", "action_log", "anchored_windows", "response_steps"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own = {**retrieval.QUERIES, **corpus.QUERIES, **live.QUERIES}
    for _ in range(2):
        began = time.perf_counter()
        spark.range(200_000_000).selectExpr("xxhash64(id, id + 1)").write.format("noop").mode("overwrite").save()
        probe = round(time.perf_counter() - began, 3)
    took = {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            own[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "probe": probe, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
