"""Times the headline queries once warm and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from linkwright.queries import QUERIES

HEADLINE = ["link_parts_best_match", "blocked_pairs", "stable_key_dedup", "broadcast_to_duplicates", "token_block_topk", "candidate_identity_merge", "cache_upsert_latest", "multi_index_lookup", "rolling_quota", "breaker_islands", "latency_summary", "playlist_tracks", "title_similarity", "redact_text", "html_title_clean", "quality_rollup", "credit_analysis", "read_csv_variants", "quality_metrics"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(min(took), 3)
    print(json.dumps({"metric": "sum of headline query seconds, best of 2", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
