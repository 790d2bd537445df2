"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs per query).
Each query runs three times to warm up; its figure is the median of the timed runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.plans import catalog  # noqa: E402
from tidemark.session import build_session  # noqa: E402

WARM_UPS = 3
HEADLINE = [
    "profile_table",
    "dataset_statistics_lineitem",
    "workspace_recommendations",
    "workspace_summary",
    "path_latency",
    "latest_report",
    "access_review",
    "parse_event_details",
    "edge_integrity",
    "sql_inner_join",
    "sql_asof_join",
    "sql_range_join",
    "sql_rank",
    "version_number",
    "land_raw",
    "stream_request_metrics",
    "train_tree_classifier",
]


def run(spark, sf_dir: str, name: str) -> float:
    """Seconds to compute every row and column of the result."""
    started = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark_ui_enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load_all()
    timings = {}
    for name in HEADLINE:
        for _ in range(WARM_UPS):
            run(spark, sf_dir, name)
        timings[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
    scale = os.path.basename(sf_dir).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
                "cpus": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
