"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then ``$BENCH_RUNS`` times; the best time counts. The noop sink
makes Spark compute every row and column without collecting them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "enforced_speed", "enforced_speed_hot_vehicle", "decision_records", "rule_changes",
    "policy_in_force", "active_decisions", "switched_enforcement", "filtered_outputs",
    "enforced_policies", "reassembled_policies", "running_contexts", "combined_inputs", "zipped_apps",
    "point_in_polygons", "sliding_median_speed", "obfuscated_positions", "rate_limited_speed",
    "noisy_speed", "dummy_locations", "warmup_records", "warmup_period", "dense_waypoints",
    "acknowledged_decisions", "restored_order", "blurred_frames",
]


def main() -> None:
    from veilstream.session import build_session
    from workload import registered
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = sys.argv[1:]
    spark = build_session("bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
                          spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = registered()
    times = {}
    for name in only or HEADLINE:
        best = None
        for run in range(runs + 1):
            started = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - started
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
