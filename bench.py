"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from modelwarden.plans import load
from modelwarden.session import local_session

HEADLINE = [
    "endpoint_metrics_daily", "endpoint_metrics_sliding", "user_sessions", "endpoint_health", "feature_drift",
    "psi_stored_edges", "null_rates", "report_gate", "class_metrics", "roc_auc", "champion", "champion_asof", "model_gate",
    "best_run", "error_segments", "feedback_gate", "training_window", "trace_rollup", "trace_outcome", "trace_positions",
    "trace_nested", "reward_trend", "escalation", "event_routing", "scope_violations", "notebook_structures",
    "rule_cascade", "response_parse", "sql_group_having", "sql_asof_join", "sql_range_join", "stream_tumbling",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    queries, _ = load()
    spark.read.parquet(f"{sf}/events.parquet").count()
    took = {}
    for name in names:
        times = []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf.rstrip("/")), "cpus": cpus, "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
