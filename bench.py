"""Wall time of headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 1),
BENCH_QUERIES (comma-separated keys, or ``all``).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from memlens.plans.catalog import registry
from memlens.session import local_session

HEADLINE = """e4_funnel e5_per_block_stats e10_calibration e14_mechanism_savings e16_usage_metrics a8_daily_usage_windows e28_resolve_feedback
b1_tokenize b3_fingerprint b5_scan_leakage b14_normalize_tool_output c1_bm25_search c3_candidate_filter c4_cosine_topk c5_jaccard_pairs c9_hybrid_rank c11_block_recall
c24_related_items d2_merge_blocks d3_upsert_facts d12_memory_health f6_fit_isotonic g2_detect_loops g4_pre_call_decisions g6_fold_turns""".split()


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    keys = sorted(registry()) if chosen == "all" else (chosen.split(",") if chosen else HEADLINE)
    spark = local_session(cpus, shuffle_partitions=8)
    spark.read.parquet(f"{sf}/events.parquet").count()  # session start is not part of a query's time
    times: dict[str, float] = {}
    for key in keys:
        took = []
        for _ in range(runs):
            start = time.perf_counter()
            registry()[key].run(spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[key] = round(statistics.median(took), 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
