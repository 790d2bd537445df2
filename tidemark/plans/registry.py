"""Registry, membership and event-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import registry
from tidemark.operators.ordered import number_within
from tidemark.operators.signals import join_counts
from tidemark.plans import stand_ins as si
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import table

# --- filters and lookups -------------------------------------------------------------------


@query(
    "filter_equal_optional",
    "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND user_id = 7",
)
def filter_equal_optional(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return registry.filter_equal(events, event_type="purchase", user_id=7, props=None).select(
        "event_id", "user_id", "event_type"
    )


@query(
    "filter_like_prefix",
    f"WITH {si.AUDIT_EVENTS_SQL} SELECT id, workspace_id, event_type FROM audit_events WHERE event_type LIKE 'metadata.%'",
)
def filter_like_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.metadata_events(si.audit_events(spark, sf_dir)).select("id", "workspace_id", "event_type")


@query(
    "point_lookup",
    "SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(l.toxic, -1) AS toxic, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "documents").select("doc_id")
    return registry.point_lookup(wanted, table(spark, sf_dir, "labels"), "doc_id").na.fill(-1, ["quality", "toxic"])


# --- joins ---------------------------------------------------------------------------------

_MEMBER = f"{si.MEMBERSHIPS_SQL}, pairs AS (SELECT DISTINCT \"user\", workspace_id FROM memberships)"


@query(
    "workspaces_for_member",
    f"WITH {_MEMBER}, ranked AS (SELECT p.\"user\", p.workspace_id, s.s_name AS name, "
    "CAST(row_number() OVER (PARTITION BY p.\"user\" ORDER BY p.workspace_id DESC) AS INTEGER) AS position "
    "FROM pairs p JOIN supplier s ON s.s_suppkey = p.workspace_id) SELECT * FROM ranked WHERE position <= 50",
)
def workspaces_for_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.workspaces_for_member(si.memberships(spark, sf_dir), si.supplier_workspaces(spark, sf_dir))


@query(
    "count_workspaces_for_member",
    f"WITH {_MEMBER} SELECT p.\"user\", COUNT(*) AS total FROM pairs p JOIN supplier s ON s.s_suppkey = p.workspace_id GROUP BY p.\"user\"",
)
def count_workspaces_for_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.count_workspaces_for_member(si.memberships(spark, sf_dir), si.supplier_workspaces(spark, sf_dir))


@query(
    "untranslated_insights",
    "WITH first_ones AS (SELECT source AS workspace_id, doc_id AS insight_id, "
    "row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents) "
    "SELECT workspace_id, insight_id FROM first_ones WHERE n <= 3 AND insight_id NOT IN (SELECT doc_id FROM labels)",
)
def untranslated_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = table(spark, sf_dir, "documents").select(
        F.col("source").alias("workspace_id"), F.col("doc_id").alias("insight_id")
    )
    translations = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("insight_id"))
    return registry.untranslated_insights(insights, translations).select("workspace_id", "insight_id")


@query(
    "parent_exists",
    "SELECT d.doc_id, d.source, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_parent FROM documents d",
)
def parent_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    children = table(spark, sf_dir, "documents").select("doc_id", "source")
    parents = table(spark, sf_dir, "labels")
    held = registry.with_parent(children, parents, "doc_id").withColumn("has_parent", F.lit(True))
    return held.unionByName(registry.orphans(children, parents, "doc_id").withColumn("has_parent", F.lit(False)))


@query(
    "edge_integrity",
    "WITH ends AS (SELECT l_returnflag AS definition_id, 'from' AS side, l_partkey AS node_id FROM lineitem "
    "UNION ALL SELECT l_returnflag, 'to', l_suppkey FROM lineitem) "
    "SELECT definition_id, side, node_id, COUNT(*) AS edges FROM ends "
    "WHERE node_id NOT IN (SELECT p_partkey FROM part WHERE p_size < 40) GROUP BY ALL",
)
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = (
        table(spark, sf_dir, "part")
        .where("p_size < 40")
        .select(F.explode(F.array(*[F.lit(f) for f in "ANR"])).alias("definition_id"), F.col("p_partkey").alias("node_id"))
    )
    edges = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("definition_id"), F.col("l_partkey").alias("from_id"), F.col("l_suppkey").alias("to_id")
    )
    return registry.dangling_references(nodes, edges)


@query(
    "signals_join",
    "SELECT c_custkey AS workspace_id, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS order_count, "
    "(SELECT COUNT(*) FROM events WHERE user_id = c_custkey) AS event_count FROM customer",
)
def signals_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = F.count(F.lit(1))
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("workspace_id")).agg(count.alias("order_count"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("workspace_id")).agg(count.alias("event_count"))
    base = si.workspaces(spark, sf_dir).select("workspace_id")
    return join_counts(base, {"order_count": orders, "event_count": events})


# --- counts and summaries ------------------------------------------------------------------


@query(
    "total_counts",
    f"WITH {si.AUDIT_EVENTS_SQL} SELECT 'workspaces' AS name, COUNT(*) AS total FROM customer "
    f"UNION ALL SELECT 'datasets', COUNT(*) FROM orders WHERE {si.ENTITIES['dataset_count']} "
    "UNION ALL SELECT 'audit', COUNT(*) FROM audit_events "
    "UNION ALL SELECT 'metadata_events', COUNT(*) FROM audit_events WHERE event_type LIKE 'metadata.%'",
)
def total_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = si.audit_events(spark, sf_dir)
    return registry.total_counts(
        workspaces=si.workspaces(spark, sf_dir),
        datasets=si.entity(spark, sf_dir, "dataset_count"),
        audit=events,
        metadata_events=registry.metadata_events(events),
    )


_DATASETS = (
    f"d AS (SELECT o_custkey AS workspace_id, o_orderkey AS id, concat('item ', o_orderkey) AS name, o_orderdate AS created_at, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n "
    f"FROM orders WHERE {si.ENTITIES['dataset_count']})"
)


@query(
    "workspace_summary",
    f"WITH {si.MEMBERSHIPS_SQL}, {_DATASETS}, held AS (SELECT workspace_id, COUNT(*) AS k, "
    "string_agg(id::VARCHAR, ',' ORDER BY n) FILTER (WHERE n <= 3) AS recent, MAX(name) FILTER (WHERE n = 1) AS latest "
    "FROM d GROUP BY workspace_id), members AS (SELECT workspace_id, COUNT(*) AS m FROM memberships GROUP BY workspace_id) "
    "SELECT c_custkey AS workspace_id, c_name AS name, coalesce(k, 0) AS dataset_count, coalesce(m, 0) AS membership_count, "
    "coalesce(k, 0) > 0 AS has_datasets, coalesce(recent, '') AS recent_ids, coalesce(latest, '') AS latest_dataset, "
    "CASE WHEN k IS NULL THEN 'Upload a CSV to create the first dataset and unlock query analysis.' "
    "ELSE concat('Open ', latest, ' and run SQL to refine the workspace.') END AS next_action "
    "FROM customer LEFT JOIN held ON held.workspace_id = c_custkey LEFT JOIN members ON members.workspace_id = c_custkey",
)
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = si.entity(spark, sf_dir, "dataset_count").withColumnRenamed("id", "dataset_id")
    summary = registry.workspace_summary(si.workspaces(spark, sf_dir), datasets, si.memberships(spark, sf_dir))
    ids = F.transform("recent_datasets", lambda d: d["dataset_id"].cast("string"))
    return summary.select(
        "workspace_id",
        "name",
        "dataset_count",
        "membership_count",
        "has_datasets",
        F.coalesce(F.array_join(ids, ","), F.lit("")).alias("recent_ids"),
        F.coalesce("latest_dataset", F.lit("")).alias("latest_dataset"),
        "next_action",
    )


@query(
    "next_action",
    f"WITH {_DATASETS} SELECT c_custkey AS workspace_id, CASE WHEN d.id IS NULL "
    "THEN 'Upload a CSV to create the first dataset and unlock query analysis.' "
    "ELSE concat('Open ', d.name, ' and run SQL to refine the workspace.') END AS next_action "
    "FROM customer LEFT JOIN d ON d.workspace_id = c_custkey AND d.n = 1",
)
def next_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = registry.newest_per_key(
        si.entity(spark, sf_dir, "dataset_count"), ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()]
    ).select("workspace_id", F.col("name").alias("latest"))
    base = si.workspaces(spark, sf_dir).select("workspace_id").join(newest, "workspace_id", "left")
    held = F.when(F.col("latest").isNull(), 0).otherwise(1)
    return base.select("workspace_id", registry.next_action(held, F.col("latest")).alias("next_action"))


# --- newest rows per key -------------------------------------------------------------------

_REPORT = ["l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "latest_report",
    "WITH r AS (SELECT l_orderkey AS dataset_id, l_shipdate AS created_at, l_linenumber, l_partkey, l_suppkey, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n "
    "FROM lineitem) SELECT dataset_id, created_at, l_linenumber, l_partkey, l_suppkey FROM r WHERE n = 1",
)
def latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("dataset_id"), F.col("l_shipdate").alias("created_at"), *_REPORT
    )
    return registry.newest_per_key(reports, ["dataset_id"], [F.col(c).desc() for c in ["created_at", *_REPORT]])


@query("newest_dataset", f"WITH {_DATASETS} SELECT workspace_id, id, created_at FROM d WHERE n = 1")
def newest_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = si.entity(spark, sf_dir, "dataset_count").select("workspace_id", "id", "created_at")
    return registry.newest_per_key(datasets, ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()])


@query(
    "recent_datasets",
    f"WITH {_DATASETS} SELECT workspace_id, id, created_at, CAST(n AS INTEGER) AS position FROM d WHERE n <= 3",
)
def recent_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    datasets = si.entity(spark, sf_dir, "dataset_count").select("workspace_id", "id", "created_at")
    return registry.newest_per_key(
        datasets, ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], 3, rank="position"
    )


@query(
    "version_number",
    "SELECT o_custkey AS workspace_id, o_orderkey AS id, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS version FROM orders",
)
def version_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at")
    )
    return number_within(versions, ["workspace_id"], [F.col("created_at"), F.col("id")], "version").select("workspace_id", "id", "version")


# --- paging --------------------------------------------------------------------------------


@query(
    "newest_first_page",
    "SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50 OFFSET 100",
)
def newest_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    return registry.newest_first_page(orders, "created_at", "id", limit=50, offset=100)


@query(
    "metadata_events_page",
    f"WITH {si.AUDIT_EVENTS_SQL} SELECT id, workspace_id, event_type, created_at FROM audit_events "
    "WHERE event_type LIKE 'metadata.%' ORDER BY created_at DESC, id DESC LIMIT 500",
)
def metadata_events_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = si.audit_events(spark, sf_dir).select("id", "workspace_id", "event_type", "created_at")
    return registry.metadata_events_page(events, limit=900)


# --- sets ----------------------------------------------------------------------------------


@query(
    "replace_open",
    "WITH old AS (SELECT o_custkey AS workspace_id, o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'open' ELSE 'done' END AS status "
    "FROM orders), redone AS (SELECT DISTINCT user_id AS workspace_id FROM events) "
    "SELECT * FROM old WHERE NOT (status = 'open' AND workspace_id IN (SELECT workspace_id FROM redone)) "
    "UNION ALL SELECT workspace_id, -workspace_id - 1, 'open' FROM redone",
)
def replace_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("workspace_id"),
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"),
    )
    redone = table(spark, sf_dir, "events").select(F.col("user_id").alias("workspace_id")).distinct()
    fresh = redone.select("workspace_id", (-F.col("workspace_id") - 1).alias("id"), F.lit("open").alias("status"))
    return registry.replace_open(existing, fresh, redone)
