"""Time the headline queries and print one JSON line.

Environment: ``BENCH_SF_DIR`` (default /root/testdata/sf0.1), ``BENCH_CPUS`` (default 8),
``BENCH_RUNS`` (default 1 timed run after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from surgecast import checks, session  # noqa: E402

HEADLINE = [
    "replicas_needed",
    "fetch_latest",
    "range_fetch",
    "dedup_last",
    "latest_rows",
    "counter_rate",
    "traffic_rates",
    "latency_p99",
    "clean_frame",
    "rolling_time",
    "engineer_features",
    "supplier_features",
    "scale_whole_table",
    "training_windows",
    "seasonal_forecast",
    "sequence_forecast",
    "prediction_results",
    "adaptive_weights",
    "orders_what_if",
    "guard_decisions",
    "frequent_events_alert",
    "streaming_bins",
    "training_run",
    "control_tick",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = session.build(f"local[{cpus}]", shuffle_partitions=cpus)
    registered = checks.load()["QUERIES"]
    seconds = {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken), 3)
        session.clear_scratch(spark)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
