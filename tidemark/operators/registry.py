"""Queries over registry and event tables, for all workspaces or datasets in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators.ordered import number_within

#: Spark cuts a task's rows per key before the shuffle up to this many.
GROUP_LIMIT = 1000

# --- filters -------------------------------------------------------------------------


def filter_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows equal to every given value; None means the test is left out."""
    for name, value in wanted.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def metadata_events(events: DataFrame, **wanted: object) -> DataFrame:
    """Events whose type starts with ``metadata.``, with optional equality tests."""
    return filter_equal(events.where(F.col("event_type").startswith("metadata.")), **wanted)


def point_lookup(wanted: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Each wanted key with the table's columns and a found flag."""
    return wanted.join(table.withColumn("_hit", F.lit(True)), key, "left").withColumn(
        "found", F.col("_hit").isNotNull()
    ).drop("_hit")


# --- paging --------------------------------------------------------------------------


def newest_first_page(
    df: DataFrame, created_at: str, key: str, limit: int = fixed.PAGE_DEFAULT, offset: int = 0
) -> DataFrame:
    """One page in newest-first order; ties fall back to the key.

    For the first page every task keeps ``limit`` rows at most. Later pages take their rows by
    position in a distributed sort, so that memory does not grow with ``offset``.
    """
    if not 1 <= limit <= fixed.PAGE_MAXIMUM:
        raise ValueError(f"limit must be between 1 and {fixed.PAGE_MAXIMUM}")
    if offset < 0:
        raise ValueError("offset must not be negative")
    order = [F.col(created_at).desc_nulls_last(), F.col(key).desc_nulls_last()]
    if offset:
        wanted = F.col("_position").between(offset + 1, offset + limit)
        return number_within(df, [], order, "_position").where(wanted).orderBy("_position").drop("_position")
    return df.orderBy(*order).limit(limit)


def metadata_events_page(
    events: DataFrame, limit: int = fixed.EVENT_PAGE_DEFAULT, created_at: str = "created_at", key: str = "id", **wanted
) -> DataFrame:
    """Newest metadata events; the limit is moved into 1..500."""
    size = max(1, min(limit, fixed.EVENT_PAGE_MAXIMUM))
    return newest_first_page(metadata_events(events, **wanted), created_at, key, size)


def total_counts(**tables: DataFrame) -> DataFrame:
    """name, total per table; each is counted on its own, without moving rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("total")).select(F.lit(n).alias("name"), "total") for n, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# --- newest rows per key ---------------------------------------------------------------


def newest_per_key(
    df: DataFrame, keys: list[str], order: list[Column], rows: int = 1, rank: str | None = None, spread: int = 1
) -> DataFrame:
    """The first ``rows`` rows of each key in the given order.

    Spark cuts every task's input to ``rows`` per key before the shuffle, so a hot key moves no
    more than that from each task. With few keys and many tasks the survivors still add up;
    ``spread`` cuts them once more in that many groups per key. Which task held a row does not
    affect the result. Above GROUP_LIMIT rows Spark makes no such cut; ranks then come from a
    range-partitioned numbering, which spreads a hot key.
    """
    if rows > GROUP_LIMIT:
        ranked = number_within(df, keys, order, "_rank").where(F.col("_rank") <= rows)
        return ranked.withColumn(rank, F.col("_rank").cast("int")).drop("_rank") if rank else ranked.drop("_rank")
    if spread > 1:
        group = Window.partitionBy(*keys, "_group").orderBy(*order)
        df = (
            df.withColumn("_group", F.spark_partition_id() % spread)
            .withColumn("_rank", F.row_number().over(group))
            .where(F.col("_rank") <= rows)
            .drop("_group", "_rank")
        )
    window = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= rows)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


# --- joins -----------------------------------------------------------------------------


def member_workspaces(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """user, workspace_id, name: every workspace a user belongs to, once."""
    pairs = memberships.select("user", "workspace_id").distinct()
    return pairs.join(workspaces, "workspace_id")


def workspaces_for_member(memberships: DataFrame, workspaces: DataFrame, limit: int = fixed.PAGE_DEFAULT) -> DataFrame:
    """The newest ``limit`` workspaces of each user, newest first by position."""
    return newest_per_key(
        member_workspaces(memberships, workspaces), ["user"], [F.col("workspace_id").desc()], limit, rank="position"
    )


def count_workspaces_for_member(memberships: DataFrame, workspaces: DataFrame) -> DataFrame:
    """user, total workspaces."""
    return member_workspaces(memberships, workspaces).groupBy("user").agg(F.count(F.lit(1)).alias("total"))


def untranslated_insights(insights: DataFrame, translations: DataFrame, first: int = 3) -> DataFrame:
    """Of each workspace's first insights, those without a translation.

    The cut comes before the check, so a workspace whose first insights are translated adds none.
    """
    leading = newest_per_key(insights, ["workspace_id"], [F.col("insight_id").asc()], first)
    return leading.join(translations.select("insight_id").distinct(), "insight_id", "left_anti")


def with_parent(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent exists."""
    return children.join(parents.select(key), key, "left_semi")


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is missing."""
    return children.join(parents.select(key), key, "left_anti")


def dangling_references(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """definition_id, side (from or to), node_id, edges: edge ends that name no node.

    ``nodes``: definition_id, node_id. ``edges``: definition_id, from_id, to_id. Ends are
    counted per node first, so a node that most edges share is checked once.
    """
    ends = edges.select(
        "definition_id",
        F.inline(
            F.array(
                F.struct(F.lit("from").alias("side"), F.col("from_id").alias("node_id")),
                F.struct(F.lit("to").alias("side"), F.col("to_id").alias("node_id")),
            )
        ),
    )
    counted = ends.groupBy("definition_id", "side", "node_id").agg(F.count(F.lit(1)).alias("edges"))
    return counted.join(nodes.select("definition_id", "node_id"), ["definition_id", "node_id"], "left_anti")


def workspace_summary(workspaces: DataFrame, datasets: DataFrame, memberships: DataFrame) -> DataFrame:
    """Counts, newest datasets and next step for every workspace.

    ``datasets``: workspace_id, dataset_id, name, created_at.
    """
    held = datasets.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("dataset_count"))
    members = memberships.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("membership_count"))
    recent = (
        newest_per_key(
            datasets,
            ["workspace_id"],
            [F.col("created_at").desc(), F.col("dataset_id").desc()],
            fixed.RECENT_DATASETS,
            rank="rank",
        )
        .groupBy("workspace_id")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "dataset_id", "name", "created_at"))).alias("recent_datasets"))
    )
    latest = F.get("recent_datasets", F.lit(0))
    return (
        workspaces.join(held, "workspace_id", "left")
        .join(members, "workspace_id", "left")
        .join(recent, "workspace_id", "left")
        .na.fill(0, ["dataset_count", "membership_count"])
        .withColumns(
            {
                "has_datasets": F.col("dataset_count") > 0,
                "latest_dataset_id": latest["dataset_id"],
                "latest_dataset": latest["name"],
                "next_action": next_action(F.col("dataset_count"), latest["name"]),
            }
        )
    )


def next_action(dataset_count: Column, latest_name: Column) -> Column:
    """What the workspace should do next."""
    return F.when(dataset_count == 0, fixed.UPLOAD_FIRST).otherwise(
        F.concat(
            F.lit("Open "), F.coalesce(latest_name, F.lit("the latest dataset")),
            F.lit(" and run SQL to refine the workspace."),
        )
    )


# --- sets ------------------------------------------------------------------------------


def replace_open(existing: DataFrame, fresh: DataFrame, workspaces: DataFrame) -> DataFrame:
    """Recommendations after regeneration: open ones of these workspaces go, all others stay, fresh ones join.

    ``workspaces``: the workspace ids that were regenerated, in any number of copies. A
    recommendation without a status is not open.
    """
    redone = workspaces.select("workspace_id").distinct().withColumn("_redone", F.lit(True))
    kept = (
        existing.join(redone, "workspace_id", "left")
        .where(F.col("_redone").isNull() | ~F.col("status").eqNullSafe("open"))
        .drop("_redone")
    )
    return kept.unionByName(fresh)
