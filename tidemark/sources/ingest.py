"""The upload path: gate, land, profile, registry rows, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.profile import profile_metadata, profile_table
from tidemark.session import scratch_path
from tidemark.sources.admission import source_admission
from tidemark.sources.files import duplicate_headers, scan_csv_raw
from tidemark.sources.sinks import (
    ingest_outcome,
    profile_event,
    report_id,
    write_ingest_outcome,
)

def uploaded_event(
    profile: DataFrame, *, workspace_id: int, dataset_id: int, source_name: str, actor: str = "system"
) -> DataFrame:
    """The audit event of an upload."""
    sentence = F.format_string("Uploaded %s with quality score %d", F.lit(source_name), "quality_score")
    return profile.select(
        F.lit(workspace_id).cast("bigint").alias("workspace_id"),
        F.lit("dataset.uploaded").alias("event_type"),
        F.lit(actor).alias("actor"),
        F.lit("dataset").alias("resource_type"),
        F.lit(dataset_id).cast("bigint").alias("resource_id"),
        sentence.alias("details"),
        F.current_timestamp().alias("created_at"),
    )


def ingest_csv(
    spark: SparkSession,
    path: str,
    root: str,
    *,
    workspace_id: int,
    dataset_id: int,
    dataset_name: str,
    file_name: str | None = None,
) -> DataFrame:
    """Take one CSV (a file or a folder of parts) through the whole path; returns its profile.

    The text is parsed once and landed as parquet under the dataset's id; the profile reads
    that. Writes under ``root``: raw, datasets, data_quality_reports, ingestion_jobs, events. Each
    upload has its own folder in all of them, so a second run with the same ids replaces the first.
    """
    request = spark.createDataFrame([(file_name or path, dataset_name)], "file_name string, dataset_name string")
    verdict = source_admission(request).first()
    if not verdict["accepted"]:
        raise ValueError(verdict["rejection"])
    raw = scan_csv_raw(spark, path)
    repeated = duplicate_headers(spark, path)
    if repeated:
        raise ValueError(f"Header names occur more than once: {', '.join(repeated)}")
    landed = f"{root}/raw/workspace_id={workspace_id}/dataset_id={dataset_id}"
    # A file that must be read whole is parsed by one task; rebalance spreads its rows.
    raw.hint("rebalance").write.mode("overwrite").parquet(landed)
    rows = spark.read.schema(raw.schema).parquet(landed)
    kept = scratch_path(spark, "profile")
    profile_metadata(profile_table(rows), verdict["source_name"], landed).write.parquet(kept)
    profile = spark.read.parquet(kept)
    upload = f"upload={workspace_id}-{dataset_id}"
    outcome = ingest_outcome(
        profile, workspace_id=workspace_id, dataset_id=dataset_id, name=dataset_name,
        source_name=verdict["source_name"], storage_path=landed,
    )
    write_ingest_outcome(outcome, root, upload)
    events = uploaded_event(
        profile, workspace_id=workspace_id, dataset_id=dataset_id, source_name=verdict["source_name"]
    ).unionByName(
        profile_event(
            profile, workspace_id=workspace_id, dataset_id=dataset_id, report_id=report_id(profile, workspace_id, dataset_id), dataset_name=dataset_name
        )
    )
    events.coalesce(1).write.mode("overwrite").parquet(f"{root}/events/{upload}")
    return profile
