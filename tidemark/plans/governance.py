"""Access, masking and audit queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import governance, registry
from tidemark.plans import stand_ins as si
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import table

ALLOWED = ["A", "N"]


def _attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS attempt_id", "o_custkey % 100 AS workspace_id", "o_orderkey % 2000 AS user"
    )


_REVIEW = (
    f"{si.MEMBERSHIPS_SQL}, roles AS (SELECT workspace_id, \"user\", MIN(role) AS role FROM memberships GROUP BY ALL), "
    "attempts AS (SELECT o_orderkey AS attempt_id, o_custkey % 100 AS workspace_id, o_orderkey % 2000 AS \"user\" FROM orders), "
    "review AS (SELECT a.*, CASE WHEN r.role IS NULL THEN 'No workspace membership found for user' "
    "WHEN r.role NOT IN ('A', 'N') THEN concat('Insufficient workspace role: ', r.role) END AS reason "
    "FROM attempts a LEFT JOIN roles r ON r.workspace_id = a.workspace_id AND r.\"user\" = a.\"user\")"
)


@query(
    "access_review",
    f"WITH {_REVIEW} SELECT attempt_id, workspace_id, \"user\", reason IS NULL AS allowed, coalesce(reason, '') AS reason FROM review",
)
def access_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = governance.access_review(_attempts(spark, sf_dir), si.memberships(spark, sf_dir), ALLOWED)
    return reviewed.select("attempt_id", "workspace_id", "user", "allowed", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "access_denied_events",
    f"WITH {_REVIEW} SELECT workspace_id, 'security.access_denied' AS event_type, CAST(\"user\" AS VARCHAR) AS actor, 'workspace' AS resource_type, "
    "workspace_id AS resource_id, reason AS details FROM review WHERE reason IS NOT NULL",
)
def access_denied_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviewed = governance.access_review(_attempts(spark, sf_dir), si.memberships(spark, sf_dir), ALLOWED)
    return governance.denial_events(reviewed).drop("created_at")


@query(
    "mask_rules",
    "SELECT p_brand AS dataset_id, p_type AS column_name, CASE CAST(MAX(p_partkey) % 4 AS INTEGER) WHEN 0 THEN 'redact' "
    "WHEN 1 THEN 'hash' WHEN 2 THEN 'partial' ELSE 'null' END AS mask_type FROM part GROUP BY p_brand, p_type",
)
def mask_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "p_brand AS dataset_id",
        "p_type AS column_name",
        "CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'redact' WHEN 1 THEN 'hash' WHEN 2 THEN 'partial' ELSE 'null' END AS mask_type",
    )
    return governance.current_rules(rules).drop("id")


@query(
    "apply_masks",
    "SELECT c_custkey, concat('***', right(c_name, 4)) AS c_name, CASE WHEN c_nationkey IS NOT NULL THEN '***' END AS c_nationkey, "
    "c_acctbal, sha256(c_mktsegment) AS c_mktsegment FROM customer",
)
def apply_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks by the newest stored rules of dataset 1; older rules and other datasets' say otherwise."""
    stored = table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey AS id", "IF(n_nationkey < 20, 1, 2) AS dataset_id",
        "element_at(array('c_name', 'c_nationkey', 'c_mktsegment'), CAST(n_nationkey % 3 + 1 AS INT)) AS column_name",
        "CASE WHEN n_nationkey >= 20 THEN 'null' WHEN n_nationkey < 17 THEN 'null' "
        "ELSE element_at(array('partial', 'redact', 'hash'), CAST(n_nationkey % 3 + 1 AS INT)) END AS mask_type",
    )
    return governance.apply_masks(table(spark, sf_dir, "customer"), governance.mask_rules(stored, 1))


@query(
    "audit_page",
    f"WITH {si.AUDIT_EVENTS_SQL} SELECT id, event_type, created_at FROM audit_events WHERE workspace_id = 7 "
    "ORDER BY created_at DESC, id DESC LIMIT 50",
)
def audit_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = registry.filter_equal(si.audit_events(spark, sf_dir), workspace_id=7)
    return registry.newest_first_page(events.select("id", "event_type", "created_at"), "created_at", "id")


@query(
    "audit_pages",
    f"WITH {si.AUDIT_EVENTS_SQL}, r AS (SELECT workspace_id, id, event_type, "
    "CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS position FROM audit_events) "
    "SELECT * FROM r WHERE position <= 50",
)
def audit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = registry.newest_per_key(
        si.audit_events(spark, sf_dir), ["workspace_id"], [F.col("created_at").desc(), F.col("id").desc()], 50,
        rank="position", spread=64,
    )
    return newest.select("workspace_id", "id", "event_type", "position")


@query(
    "audit_type_set",
    f"WITH {si.AUDIT_EVENTS_SQL} SELECT workspace_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS event_types "
    "FROM audit_events GROUP BY workspace_id",
)
def audit_type_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.audit_type_sets(si.audit_events(spark, sf_dir))
