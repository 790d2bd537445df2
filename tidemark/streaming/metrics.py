"""Request metrics as continuous queries.

Results are kept as versions: micro-batch N writes ``<target>/batch=N`` and overwrites it when
the batch is replayed, so a lost driver or executor cannot count a row twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import fixed_values as fixed
from tidemark.operators.metrics import last_n_per_path, latency_of
from tidemark.operators.registry import newest_per_key


def stream_parquet(spark: SparkSession, path: str, file_glob: str, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream, in the schema of those already there."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def start(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str, available_now: bool = True
) -> StreamingQuery:
    """Start a query that hands every micro-batch to ``write``."""
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def write_version(target: str, kept: int | None = None) -> Callable[[DataFrame, int], None]:
    """Batch writer of one version a batch; with ``kept``, older versions than that many are removed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if kept and batch_id >= kept:
            _remove(batch.sparkSession, f"{target}/batch={batch_id - kept}")

    return write


def newest_version(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """Result of a complete-mode query: its last version holds every row."""
    return spark.read.parquet(f"{target}/batch={batch_id}")


def latest_rows(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """Result of an update-mode query: the newest stored row per key over all versions."""
    newest = newest_per_key(spark.read.parquet(target), keys, [F.col("batch").desc()])
    return newest.drop("batch")


def request_counts(log: DataFrame) -> DataFrame:
    """Running count per path and status; few rows, so meant for complete mode."""
    return log.groupBy("path", "status").agg(F.count(F.lit(1)).alias("requests"))


def error_counts(log: DataFrame) -> DataFrame:
    """Running count per error type, for complete mode."""
    return log.where(F.col("error_type").isNotNull()).groupBy("error_type").agg(F.count(F.lit(1)).alias("errors"))


def windowed_counts(events: DataFrame, delay: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Tumbling counts per event type; a window is closed and its state dropped once it is ``delay`` past.

    What comes later than that is not counted, which is the price of a closed window.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return (
        timed.groupBy(F.window("ts", width).alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("events"))
        .select(
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "event_type",
            "events",
        )
    )


def batch_windows(target: str, width: str = "1 day") -> Callable[[DataFrame, int], None]:
    """Batch writer of tumbling counts per event type: each batch stores its own counts.

    No watermark: late events count like others, and no state is held. ``summed_windows``
    adds the versions up; a replayed batch overwrites its own.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = (
            batch.groupBy(F.window("ts", width).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("events"))
            .select(
                F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                F.col("w.end").cast("timestamp_ntz").alias("window_end"),
                "event_type",
                "events",
            )
        )
        counts.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return write


def summed_windows(spark: SparkSession, target: str) -> DataFrame:
    """Counts per window and event type over all stored batches."""
    return spark.read.parquet(target).groupBy("window_start", "window_end", "event_type").agg(F.sum("events").alias("events"))


def bounded_samples(target: str, n: int = fixed.LATENCY_SAMPLES) -> Callable[[DataFrame, int], None]:
    """Batch writer that keeps each path's newest ``n`` requests.

    Version N is made from version N-1 and the batch. Both are cut to ``n`` per path in every
    task before the shuffle, so neither a hot path nor a long history gathers in one place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{target}/batch={batch_id - 1}").unionByName(batch)
        last_n_per_path(rows, n).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        # The version before the last is kept for a replay of this batch.
        if batch_id > 1:
            _remove(spark, f"{target}/batch={batch_id - 2}")

    return write


def bounded_latency(spark: SparkSession, target: str, batch_id: int) -> DataFrame:
    """Average and p95 per path from a stored version of the samples."""
    return latency_of(spark.read.parquet(f"{target}/batch={batch_id}"))


def last_batch_id(query: StreamingQuery) -> int:
    """Id of the newest finished micro-batch."""
    return max(p["batchId"] for p in query.recentProgress)
