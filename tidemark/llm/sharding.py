"""Sharding by a two-pass external shuffle, with DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged

SHARDS = 40
#: Bytes of text that one bucket holds on average: it is shuffled in memory by one task.
BUCKET_BYTES = 16 << 20


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text plus 16 for the record; a null text has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def shuffled_shards(
    docs: DataFrame, shards: int = SHARDS, seed: int = 17, bucket_bytes: int = BUCKET_BYTES,
    text: str = "text", key: str = "doc_id",
) -> DataFrame:
    """``record`` (every column of ``docs``), ``shard`` and ``slot``: all rows in a seeded random order, cut evenly.

    Pass 1 scatters the records over buckets by a seeded hash; as many buckets are made as keep each
    near ``bucket_bytes``. Pass 2 sorts a bucket, permutes it by Fisher-Yates (Spark's ``shuffle``) and
    writes it to the shared folder. The buckets in a row are the shuffled order, and shard i of n holds
    the positions from i/n to (i+1)/n of it, so that row counts differ by one at most. Text moves once.

    The hash takes key, text and input partition: copies of a text or a null key spread like other
    rows, and rows repeated in full spread over their partitions' buckets. A bucket is one task's
    partition, so the seed and the bucket fix its order: a lost task repeats it. An empty table gives
    no rows; null texts count 16 bytes. One record longer than a bucket makes that bucket larger.
    """
    total = docs.agg(F.sum(text_bytes(F.col(text))).alias("bytes")).first()["bytes"] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    crc = F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0))
    scattered = docs.select(
        F.struct(F.struct(F.col(key).alias("key"), crc.alias("crc")).alias("by"), F.struct("*").alias("record")).alias("row"),
        F.pmod(F.xxhash64(F.lit(seed), F.col(key), crc, F.spark_partition_id()), F.lit(buckets)).cast("int").alias("bucket"),
    )
    by_content = "(a, b) -> CASE WHEN a.by < b.by THEN -1 WHEN a.by > b.by THEN 1 ELSE 0 END"
    drawn = (
        scattered.repartitionById(buckets, F.col("bucket"))
        .groupBy("bucket")
        .agg(F.collect_list("row").alias("rows"))
        .select("bucket", F.shuffle(F.expr(f"array_sort(rows, {by_content})"), seed).alias("rows"))
        .select("bucket", F.posexplode("rows").alias("place", "row"))
        .select("bucket", "place", "row.record")
    )
    written = staged(drawn, "shuffled")
    sizes = written.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))
    # Two levels of running counts, so that no task sees more than about a thousand buckets.
    block = F.floor(F.col("bucket") / 1000)
    inner = Window.partitionBy("block").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("block", block)
    blocks = sizes.groupBy("block").agg(F.sum("rows").alias("rows")).select(
        "block", F.coalesce(F.sum("rows").over(outer), F.lit(0)).alias("base")
    )
    offsets = (
        sizes.withColumn("inside", F.coalesce(F.sum("rows").over(inner), F.lit(0)))
        .join(blocks, "block")
        .select("bucket", (F.col("base") + F.col("inside")).alias("offset"))
    )
    # Written first, so that Spark knows how small it is before it plans the join.
    offsets = staged(offsets, "offsets")
    count = written.count()
    position = "(offset + place)"
    shard = f"({shards}L * ({position} + 1) - 1) div {max(count, 1)}L"
    return (
        written.join(offsets, "bucket")
        .withColumn("shard", F.expr(shard))
        .select(
            "record",
            F.col("shard").cast("int").alias("shard"),
            F.expr(f"{position} - (shard * {count}L) div {shards}L").alias("slot"),
        )
    )


def write_shards(shards: DataFrame, path: str) -> None:
    """Write the shards' records under ``path``, one folder a shard, with the slot that orders them."""
    shards.select("record.*", "shard", F.col("slot").alias("_slot")).write.partitionBy("shard").parquet(path)
