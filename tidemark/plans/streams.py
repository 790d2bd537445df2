"""Streaming queries: each runs over all files present, then returns the stored result."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.catalog import query
from tidemark.plans.metrics import LATENCY_SQL
from tidemark.plans.stand_ins import EVENT_TYPE, REQUEST_COLUMNS, REQUEST_LOG_SQL
from tidemark.session import scratch_path
from tidemark.streaming import audit, metrics


#: Bytes of the stored table in a micro-batch, about.
BATCH_BYTES = 128 << 20


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as a stream of batches of about BATCH_BYTES, two at least, newest days first: most of it comes late."""
    path = scratch_path(spark, "events")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    size = int(str(events._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    batches = max(2, math.ceil(size / BATCH_BYTES))
    events.repartitionByRange(batches, F.col("ts").desc()).write.parquet(path)
    # A deployment may deal out more files than asked for; a batch then takes several.
    files = len(spark.read.parquet(path).inputFiles())
    return metrics.stream_parquet(spark, path, "*.parquet", files_per_batch=max(1, math.ceil(files / batches)))


def _in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as one file: nothing is late, so that windows close as they should."""
    return metrics.stream_parquet(spark, sf_dir, "events.parquet")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).selectExpr(*REQUEST_COLUMNS)


def _run(spark: SparkSession, df: DataFrame, write, label: str, mode: str):
    running = metrics.start(df, write, scratch_path(spark, f"{label}-state"), mode)
    running.awaitTermination()
    return running


def _complete(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    target = scratch_path(spark, label)
    running = _run(spark, df, metrics.write_version(target, kept=2), label, "complete")
    return metrics.newest_version(spark, target, metrics.last_batch_id(running))


def _changes(spark: SparkSession, df: DataFrame, label: str, keys: list[str], mode: str) -> DataFrame:
    target = scratch_path(spark, label)
    _run(spark, df, metrics.write_version(target), label, mode)
    return metrics.latest_rows(spark, target, keys)


@query(
    "stream_request_metrics",
    f"WITH {REQUEST_LOG_SQL} SELECT path, status, COUNT(*) AS requests FROM request_log GROUP BY path, status",
)
def stream_request_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, metrics.request_counts(_log(spark, sf_dir)), "requests")


@query(
    "stream_errors",
    f"WITH {REQUEST_LOG_SQL} SELECT error_type, COUNT(*) AS errors FROM request_log WHERE error_type IS NOT NULL GROUP BY error_type",
)
def stream_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _complete(spark, metrics.error_counts(_log(spark, sf_dir)), "errors")


@query("stream_bounded_latency", f"{LATENCY_SQL} SELECT path, avg_ms, p95_ms FROM l")
def stream_bounded_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "samples")
    log = _log(spark, sf_dir).select("event_id", "ts", "path", "duration_ms")
    running = _run(spark, log, metrics.bounded_samples(target), "samples", "append")
    return metrics.bounded_latency(spark, target, metrics.last_batch_id(running))


_WINDOWS = (
    "SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, date_trunc('day', ts)::TIMESTAMP + INTERVAL 1 DAY AS window_end, event_type, COUNT(*) AS events "
    "FROM events GROUP BY ALL"
)


@query("windowed_event_counts", _WINDOWS)
def windowed_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "windows")
    _run(spark, _events(spark, sf_dir), metrics.batch_windows(target), "windows", "append")
    return metrics.summed_windows(spark, target)


@query(
    "closed_event_windows",
    f"SELECT * FROM ({_WINDOWS}) w WHERE window_end <= (SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR",
)
def closed_event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = metrics.windowed_counts(_in_order(spark, sf_dir))
    return _changes(spark, counts, "closed", ["window_start", "event_type"], "append")


@query(
    "stream_audit_sink",
    f"WITH e AS (SELECT DISTINCT event_id, {EVENT_TYPE} AS event_type FROM events) SELECT CASE WHEN event_type LIKE 'metadata.%' THEN 'metadata' "
    "ELSE 'audit' END AS stream, event_type, COUNT(*) AS events FROM e GROUP BY ALL",
)
def stream_audit_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "audit")
    events = _events(spark, sf_dir).withColumn("event_type", F.expr(EVENT_TYPE))
    _run(spark, events, audit.append_new_events(target), "audit", "append")
    return spark.read.parquet(target).groupBy("stream", "event_type").agg(F.count(F.lit(1)).alias("events"))
