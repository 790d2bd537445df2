"""Continuous append of the event log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_new_events(target: str) -> Callable[[DataFrame, int], None]:
    """Batch writer of a log that loses no event and keeps each event_id once, however late it comes.

    ``metadata.*`` events go to one branch of the log, all others to another. Repeats are
    dropped by an anti-join against the stored events of the batch's own days, so a batch reads
    only the partitions it touches; an event without an id is always kept. A batch has its own
    folder, so a replay replaces it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        day = F.coalesce(F.to_date("ts").cast("string"), F.lit("unknown"))
        rows = batch.withColumn("day", day)
        named = rows.where("event_id IS NOT NULL").dropDuplicates(["event_id"])
        fresh = named.unionByName(rows.where("event_id IS NULL"))
        if batch_id > 0:
            days = [r["day"] for r in rows.select("day").distinct().collect()]
            kind = batch.schema["event_id"].dataType.simpleString()
            stored = spark.read.schema(f"event_id {kind}, stream string, day string, batch int").parquet(target).where(F.col("day").isin(days) & (F.col("batch") < batch_id))
            fresh = fresh.join(stored.select("event_id").distinct(), "event_id", "left_anti")
        stream = F.when(F.col("event_type").startswith("metadata."), "metadata").otherwise("audit")
        (
            fresh.withColumn("stream", stream)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .partitionBy("stream", "day")
            .parquet(f"{target}/batch={batch_id}")
        )

    return write
