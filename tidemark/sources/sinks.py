"""Writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.profile import profile_json


def land_raw(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace the given partitions with ``df``; other partitions stay.

    ``rebalance`` gathers small partitions into few files and lets a large one be written by
    many tasks. The commit step swaps partition by partition: a reader sees a partition's old rows or its new ones, but may
    see some partitions before and others after the swap, and on object stores files of both until it ends.
    """
    (
        df.hint("rebalance", *partition_by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def report_id(profile: DataFrame, workspace_id: int, dataset_id: int) -> Column:
    """The id of a stored report: it follows from the dataset and what the profile says."""
    return F.xxhash64(F.lit(workspace_id), F.lit(dataset_id), profile_fingerprint_text(profile))


def profile_fingerprint_text(profile: DataFrame) -> Column:
    return F.col("profile_fingerprint") if "profile_fingerprint" in profile.columns else F.to_json(F.struct("columns", "row_count"))


def ingest_outcome(
    profile: DataFrame, *, workspace_id: int, dataset_id: int, name: str, source_name: str, storage_path: str
) -> dict[str, DataFrame]:
    """Registry rows that follow from one profile: datasets, data_quality_reports, ingestion_jobs."""
    now = F.current_timestamp()
    dataset = profile.select(
        F.lit(dataset_id).cast("bigint").alias("id"),
        F.lit(workspace_id).cast("bigint").alias("workspace_id"),
        F.lit(name).alias("name"),
        F.lit("file").alias("source_type"),
        F.lit("raw").alias("state"),
        F.lit(storage_path).alias("storage_path"),
        now.alias("created_at"),
    )
    report = profile_json(profile).select(
        report_id(profile, workspace_id, dataset_id).alias("id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        "summary_json",
        now.alias("created_at"),
    )
    job = profile.select(
        F.lit(workspace_id).cast("bigint").alias("workspace_id"),
        F.lit(dataset_id).cast("bigint").alias("dataset_id"),
        F.lit(source_name).alias("source_name"),
        F.lit("file").alias("source_type"),
        F.lit("completed").alias("status"),
        "row_count",
        "rejected_rows",
        "quality_score",
        F.lit(None).cast("string").alias("error_message"),
        now.alias("finished_at"),
    )
    return {"datasets": dataset, "data_quality_reports": report, "ingestion_jobs": job}


def write_ingest_outcome(tables: dict[str, DataFrame], root: str, upload: str) -> None:
    """Put each registry table's rows under ``root``, in the folder of this upload, in place of what it held."""
    for name, rows in tables.items():
        rows.coalesce(1).write.mode("overwrite").parquet(f"{root}/{name}/{upload}")


def event_rows(
    df: DataFrame,
    *,
    event_type: Column,
    workspace_id: Column,
    resource_type: Column,
    resource_id: Column,
    details: dict[str, Column],
    actor: Column | None = None,
    created_at: Column | None = None,
) -> DataFrame:
    """Any rows in the event log's schema; details become JSON with sorted keys."""
    document = F.to_json(F.struct(*[details[k].alias(k) for k in sorted(details)]))
    return df.select(
        workspace_id.cast("bigint").alias("workspace_id"),
        event_type.alias("event_type"),
        (F.lit(None).cast("string") if actor is None else actor).alias("actor"),
        resource_type.alias("resource_type"),
        resource_id.cast("bigint").alias("resource_id"),
        document.alias("details"),
        (F.current_timestamp() if created_at is None else created_at).alias("created_at"),
    )


def emit_events(events: DataFrame, path: str) -> None:
    """Append event rows to the log."""
    events.write.mode("append").parquet(path)


def profile_event(
    profile: DataFrame, *, workspace_id: int, dataset_id: int, report_id: int | Column, dataset_name: str, actor: str = "system"
) -> DataFrame:
    """The event recorded when a dataset has been profiled."""
    return event_rows(
        profile,
        event_type=F.lit("metadata.ingestion.profile_created"),
        workspace_id=F.lit(workspace_id),
        resource_type=F.lit("dataset"),
        resource_id=F.lit(dataset_id),
        actor=F.lit(actor),
        details={
            "dataset_name": F.lit(dataset_name),
            "report_id": F.lit(report_id),
            "row_count": F.col("row_count"),
            "rejected_rows": F.col("rejected_rows"),
            "quality_score": F.col("quality_score"),
        },
    )
