"""Access review, column masks and audit reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import column
from tidemark.operators.registry import newest_per_key

MASKS = ("redact", "hash", "partial", "null")


def access_review(attempts: DataFrame, memberships: DataFrame, allowed: list[str]) -> DataFrame:
    """Add role, allowed and reason to access attempts (attempt_id, workspace_id, user).

    A user's role in a workspace is the first in name order when several are stored.
    """
    roles = memberships.groupBy("workspace_id", "user").agg(F.min("role").alias("role"))
    reason = F.when(F.col("role").isNull(), F.lit(fixed.NO_MEMBERSHIP)).when(
        ~F.col("role").isin(allowed), F.concat(F.lit(fixed.WRONG_ROLE), F.col("role"))
    )
    return attempts.join(roles, ["workspace_id", "user"], "left").withColumns(
        {"reason": reason, "allowed": reason.isNull()}
    )


def denial_events(reviewed: DataFrame) -> DataFrame:
    """Event-log rows for refused attempts, with the reason as details."""
    return reviewed.where(~F.col("allowed")).select(
        F.col("workspace_id").cast("bigint").alias("workspace_id"),
        F.lit("security.access_denied").alias("event_type"),
        F.col("user").cast("string").alias("actor"),
        F.lit("workspace").alias("resource_type"),
        F.col("workspace_id").cast("bigint").alias("resource_id"),
        F.col("reason").alias("details"),
        F.current_timestamp().alias("created_at"),
    )


def current_rules(masks: DataFrame) -> DataFrame:
    """The newest stored rule of each dataset column. ``masks``: id, dataset_id, column_name, mask_type."""
    return newest_per_key(masks, ["dataset_id", "column_name"], [F.col("id").desc()])


def mask_rules(masks: DataFrame, dataset_id: object) -> dict[str, str]:
    """column -> mask type of one dataset; as many entries as the dataset has masked columns."""
    rows = current_rules(masks.where(F.col("dataset_id") == F.lit(dataset_id))).select("column_name", "mask_type").collect()
    return {r["column_name"]: r["mask_type"] for r in rows}


def mask(cell: Column, mask_type: str) -> Column:
    """A masked cell as text; null stays null."""
    text = cell.cast("string")
    if mask_type == "redact":
        return F.when(text.isNotNull(), F.lit("***"))
    if mask_type == "hash":
        return F.sha2(text, 256)
    if mask_type == "partial":
        # A value of four characters or fewer would show in full.
        return F.when(F.length(text) > 4, F.concat(F.lit("***"), F.right(text, F.lit(4)))).when(text.isNotNull(), F.lit("***"))
    if mask_type == "null":
        return F.lit(None).cast("string")
    raise ValueError(f"Unknown mask type '{mask_type}', expected one of {', '.join(MASKS)}")


def apply_masks(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """The table with masked columns in place."""
    unknown = sorted(set(rules) - set(df.columns))
    if unknown:
        raise ValueError(f"Masked columns not in the table: {', '.join(unknown)}")
    return df.select([mask(column(n), rules[n]).alias(n) if n in rules else column(n) for n in df.columns])


def audit_type_sets(events: DataFrame) -> DataFrame:
    """workspace_id, event_types (sorted, joined by commas).

    Pairs are made distinct first, so a workspace gathers one row per type, not per event.
    """
    pairs = events.select("workspace_id", "event_type").distinct()
    return pairs.groupBy("workspace_id").agg(
        F.array_join(F.sort_array(F.collect_list("event_type")), ",").alias("event_types")
    )
