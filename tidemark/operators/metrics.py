"""Request metrics in batch.

Input: a request log with event_id, ts, path, status, duration_ms and error_type (null when fine).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators.registry import newest_per_key

# Paths are few and requests many: see newest_per_key.
PATH_GROUPS = 64


def _newest() -> list[Column]:
    return [F.col("ts").desc(), F.col("event_id").desc()]


def request_totals(log: DataFrame) -> DataFrame:
    """metric, label, total: all requests, all errors, per status and per error type, in one pass."""
    tags = F.filter(
        F.array(
            F.struct(F.lit("request").alias("metric"), F.lit("all").alias("label")),
            F.struct(F.lit("status").alias("metric"), F.col("status").cast("string").alias("label")),
            F.when(F.col("error_type").isNotNull(), F.struct(F.lit("error").alias("metric"), F.lit("all").alias("label"))),
            F.when(
                F.col("error_type").isNotNull(),
                F.struct(F.lit("error_type").alias("metric"), F.col("error_type").alias("label")),
            ),
        ),
        lambda tag: tag.isNotNull(),
    )
    counted = log.groupBy("status", "error_type").agg(F.count(F.lit(1)).alias("requests"))
    return (
        counted.select("requests", F.inline(tags))
        .groupBy("metric", "label")
        .agg(F.sum("requests").alias("total"))
    )


def last_n_per_path(log: DataFrame, n: int = fixed.LATENCY_SAMPLES) -> DataFrame:
    """The newest ``n`` requests of each path."""
    return newest_per_key(log, ["path"], _newest(), n, spread=PATH_GROUPS)


def recent_requests(log: DataFrame, n: int = fixed.RECENT_SHOWN) -> DataFrame:
    """The newest ``n`` requests overall."""
    return log.orderBy(*_newest()).limit(n)


def rank_quantile(values: Column, quantile: float = 0.95) -> Column:
    """Element at index floor((n - 1) * quantile) of the sorted array, two decimals; no interpolation."""
    ordered = F.sort_array(values)
    index = F.floor((F.size(ordered) - 1) * F.lit(quantile)).cast("int")
    return F.round(F.get(ordered, index), 2)


def latency_of(samples: DataFrame) -> DataFrame:
    """path, avg_ms, p95_ms of sample rows; each path holds a bounded number of them."""
    return samples.groupBy("path").agg(
        F.round(F.avg("duration_ms"), 2).alias("avg_ms"),
        rank_quantile(F.collect_list("duration_ms")).alias("p95_ms"),
    )


def path_latency(log: DataFrame, n: int = fixed.LATENCY_SAMPLES) -> DataFrame:
    """path, requests (all time), avg_ms and p95_ms over the newest ``n`` durations."""
    counts = log.groupBy("path").agg(F.count(F.lit(1)).alias("requests"))
    return counts.join(latency_of(last_n_per_path(log, n)), "path")


def busiest_paths(log: DataFrame, n: int = fixed.BUSIEST_PATHS) -> DataFrame:
    """The ``n`` paths with most requests."""
    counts = log.groupBy("path").agg(F.count(F.lit(1)).alias("requests"))
    return counts.orderBy(F.col("requests").desc(), F.col("path").asc()).limit(n)
