"""Workspace maturity counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed


def workspace_signals(workspaces: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per workspace with a count per table, 0 where it has none.

    ``tables``: signal name to a frame with workspace_id. Tagged rows of all tables and the
    workspace list share one partial aggregate and one shuffle; no joins.
    """
    tagged = [workspaces.select("workspace_id", F.lit("workspace").alias("tag"))]
    tagged += [df.select("workspace_id", F.lit(signal).alias("tag")) for signal, df in tables.items()]
    counts = [F.count_if(F.col("tag") == signal).alias(signal) for signal in tables]
    return (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("workspace_id")
        .agg(F.count_if(F.col("tag") == "workspace").alias("_listed"), *counts)
        .where("_listed > 0")
        .drop("_listed")
    )


def join_counts(workspaces: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Put counts that already exist side by side per workspace, 0 where missing.

    Each frame: workspace_id and a column named like its key.
    """
    out = workspaces
    for name, df in counts.items():
        out = out.join(df.select("workspace_id", name), "workspace_id", "left")
    return out.na.fill(0, list(counts))


def recommendation_signals(signals: DataFrame) -> DataFrame:
    return signals.select("workspace_id", *fixed.RECOMMENDATION_SIGNALS)


def guidance_signals(signals: DataFrame) -> DataFrame:
    return signals.select("workspace_id", *fixed.GUIDANCE_SIGNALS)
