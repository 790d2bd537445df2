"""Streams over many micro-batches equal the batch result."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import metrics as batch
from tidemark.plans import streams
from tidemark.plans.stand_ins import EVENT_TYPE, REQUEST_COLUMNS
from tidemark.session import scratch_path
from tidemark.streaming import audit, metrics

SOURCE = "/root/testdata/sf0.001/events.parquet"


@pytest.fixture(scope="module")
def folder(spark):
    """The events table as six files in time order."""
    path = scratch_path(spark, "six-files")
    events = spark.read.parquet(SOURCE)
    for part in range(6):
        events.where(F.col("event_id") % 6 == part).coalesce(1).write.mode("append").parquet(path)
    return path


def stream(spark, folder):
    return metrics.stream_parquet(spark, folder, "*.parquet", files_per_batch=1)


def rows(df):
    return sorted(tuple(r[c] for c in sorted(df.columns)) for r in df.collect())


def test_counts(spark, folder):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    counts = metrics.request_counts(stream(spark, folder).selectExpr(*REQUEST_COLUMNS))
    running = metrics.start(counts, metrics.write_version(target), state, "complete")
    running.awaitTermination()
    last = metrics.last_batch_id(running)
    assert last >= 5
    log = spark.read.parquet(SOURCE).selectExpr(*REQUEST_COLUMNS)
    assert rows(metrics.newest_version(spark, target, last)) == rows(metrics.request_counts(log))


def test_bounded_latency(spark, folder):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    log = stream(spark, folder).selectExpr(*REQUEST_COLUMNS).select("event_id", "ts", "path", "duration_ms")
    keep = metrics.bounded_samples(target, 30)
    running = metrics.start(log, keep, state, "append")
    running.awaitTermination()
    last = metrics.last_batch_id(running)
    whole = spark.read.parquet(SOURCE).selectExpr(*REQUEST_COLUMNS)
    expected = rows(batch.latency_of(batch.last_n_per_path(whole, 30)))
    assert rows(metrics.bounded_latency(spark, target, last)) == expected
    # A replayed batch replaces its own version.
    replay = spark.read.parquet(f"{target}/batch={last}").limit(0)
    before = rows(spark.read.parquet(f"{target}/batch={last - 1}"))
    keep(replay, last)
    assert rows(spark.read.parquet(f"{target}/batch={last}")) == before


@pytest.fixture
def newest_first(spark):
    """Three files, the newest days in the first, and one repeated."""
    path = scratch_path(spark, "late")
    events = spark.read.parquet(SOURCE)
    for low, high in ((0.66, 1.1), (0.33, 0.66), (0.0, 0.33), (0.66, 1.1)):
        part = events.withColumn("_p", F.percent_rank().over(Window.orderBy("ts"))).where(f"_p >= {low} AND _p < {high}").drop("_p")
        part.coalesce(1).write.mode("append").parquet(path)
    return path


def test_late_windows_are_counted(spark, newest_first):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    events = metrics.stream_parquet(spark, newest_first, "*.parquet", 1)
    metrics.start(events, metrics.batch_windows(target), state, "append").awaitTermination()
    got = metrics.summed_windows(spark, target)
    assert got.agg(F.sum("events")).first()[0] == spark.read.parquet(newest_first).count()


def test_audit_sink_keeps_late_events_and_drops_repeats(spark, newest_first):
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    events = metrics.stream_parquet(spark, newest_first, "*.parquet", 1).withColumn("event_type", F.expr(EVENT_TYPE))
    metrics.start(events, audit.append_new_events(target), state, "append").awaitTermination()
    written = spark.read.parquet(target)
    assert written.count() == spark.read.parquet(SOURCE).count()
    assert written.where("stream = 'metadata' AND event_type NOT LIKE 'metadata.%'").count() == 0
    audit.append_new_events(target)(events_of(spark, newest_first), 1)
    assert spark.read.parquet(target).select("event_id").distinct().count() == spark.read.parquet(SOURCE).count()


def events_of(spark, path):
    return spark.read.parquet(path).withColumn("event_type", F.expr(EVENT_TYPE))


def test_quantile_of_one_to_ten(spark):
    values = F.array(*[F.lit(float(v)) for v in range(10, 0, -1)])
    assert spark.range(1).select(batch.rank_quantile(values)).first()[0] == 9.0


def test_batches_grow_with_the_table(spark, monkeypatch):
    """A batch holds a bounded part of the table, so a larger table has more of them."""
    monkeypatch.setattr(streams, "BATCH_BYTES", 5000, raising=False)
    target, state = scratch_path(spark, "t"), scratch_path(spark, "s")
    events = streams._events(spark, SOURCE.rpartition("/")[0])
    running = metrics.start(events, metrics.batch_windows(target), state, "append")
    running.awaitTermination()
    assert metrics.last_batch_id(running) >= 4
    assert metrics.summed_windows(spark, target).agg(F.sum("events")).first()[0] == spark.read.parquet(SOURCE).count()
