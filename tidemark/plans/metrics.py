"""Request-metric queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import metrics
from tidemark.plans import stand_ins as si
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import REQUEST_LOG_SQL


@query(
    "request_totals",
    f"WITH {REQUEST_LOG_SQL} SELECT 'request' AS metric, 'all' AS label, COUNT(*) AS total FROM request_log "
    "UNION ALL SELECT 'error', 'all', COUNT(*) FROM request_log WHERE error_type IS NOT NULL "
    "UNION ALL SELECT 'status', status::VARCHAR, COUNT(*) FROM request_log GROUP BY status "
    "UNION ALL SELECT 'error_type', error_type, COUNT(*) FROM request_log WHERE error_type IS NOT NULL GROUP BY error_type",
)
def request_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.request_totals(si.request_log(spark, sf_dir))


_NEWEST = "r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, event_id DESC) AS n FROM request_log)"
LATENCY_SQL = (
    f"WITH {REQUEST_LOG_SQL}, {_NEWEST}, s AS (SELECT path, duration_ms FROM r WHERE n <= 200), "
    "l AS (SELECT path, ROUND(AVG(duration_ms), 2) AS avg_ms, "
    "ROUND(list_sort(list(duration_ms))[CAST(floor((COUNT(*) - 1) * 0.95) AS INTEGER) + 1], 2) AS p95_ms FROM s GROUP BY path)"
)


@query(
    "path_latency",
    f"{LATENCY_SQL} SELECT path, (SELECT COUNT(*) FROM request_log q WHERE q.path = l.path) AS requests, avg_ms, p95_ms FROM l",
)
def path_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.path_latency(si.request_log(spark, sf_dir))


@query("last_n_per_key", f"WITH {REQUEST_LOG_SQL}, {_NEWEST} SELECT path, event_id, duration_ms FROM r WHERE n <= 200")
def last_n_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.last_n_per_path(si.request_log(spark, sf_dir)).select("path", "event_id", "duration_ms")


@query(
    "recent_requests",
    f"WITH {REQUEST_LOG_SQL} SELECT event_id, path, status, duration_ms FROM request_log ORDER BY ts DESC, event_id DESC LIMIT 20",
)
def recent_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.recent_requests(si.request_log(spark, sf_dir)).select("event_id", "path", "status", "duration_ms")


@query(
    "busiest_paths",
    f"WITH {REQUEST_LOG_SQL} SELECT path, COUNT(*) AS requests FROM request_log GROUP BY path ORDER BY requests DESC, path LIMIT 10",
)
def busiest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.busiest_paths(si.request_log(spark, sf_dir))
