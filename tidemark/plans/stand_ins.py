"""Driver tables in the role of registry tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- registry entities kept in orders ------------------------------------------------------

# entity -> condition on orders; workspace = o_custkey, id = o_orderkey, created_at = o_orderdate
ENTITIES = {
    "dataset_count": "o_orderstatus = 'O'",
    "dashboard_count": "o_orderpriority = '1-URGENT'",
    "pipeline_count": "o_orderstatus = 'F'",
    "model_count": "o_orderstatus = 'P'",
    "insight_count": "o_orderpriority = '2-HIGH'",
    "translation_count": "o_orderpriority = '3-MEDIUM'",
    "comment_count": "o_orderpriority = '4-NOT SPECIFIED'",
    "share_count": "o_orderpriority = '5-LOW'",
    "guidance_count": "o_orderpriority = '5-LOW' AND o_totalprice > 250000",
}


def workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("workspace_id"), F.col("c_name").alias("name"))


def entity(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """workspace_id, id, name, created_at of one kind of registry row."""
    return (
        table(spark, sf_dir, "orders")
        .where(ENTITIES[name])
        .select(
            F.col("o_custkey").alias("workspace_id"),
            F.col("o_orderkey").alias("id"),
            F.concat(F.lit("item "), F.col("o_orderkey").cast("string")).alias("name"),
            F.col("o_orderdate").alias("created_at"),
        )
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.operators.signals import workspace_signals

    return workspace_signals(
        workspaces(spark, sf_dir), {name: entity(spark, sf_dir, name) for name in ENTITIES}
    )


SIGNALS_SQL = (
    "signals AS (SELECT c.c_custkey AS workspace_id, "
    + ", ".join(f"COUNT(*) FILTER (WHERE {test}) AS {name}" for name, test in ENTITIES.items())
    + " FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey)"
)

# --- members, events, request log ----------------------------------------------------------


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_suppkey").alias("workspace_id"), F.col("l_partkey").alias("user"), F.col("l_returnflag").alias("role")
        )
        .distinct()
    )


MEMBERSHIPS_SQL = (
    'memberships AS (SELECT DISTINCT l_suppkey AS workspace_id, l_partkey AS "user", l_returnflag AS role FROM lineitem)'
)


def supplier_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("workspace_id"), F.col("s_name").alias("name"))


EVENT_TYPE = "CASE WHEN event_type IN ('view', 'click') THEN concat('metadata.', event_type) ELSE event_type END"


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "user_id AS workspace_id", f"{EVENT_TYPE} AS event_type", "ts AS created_at", "props AS details"
    )


AUDIT_EVENTS_SQL = (
    f"audit_events AS (SELECT event_id AS id, user_id AS workspace_id, {EVENT_TYPE} AS event_type, "
    "ts AS created_at, props AS details FROM events)"
)

REQUEST_COLUMNS = [
    "event_id",
    "ts",
    "event_type AS path",
    "CASE WHEN event_type = 'error' THEN 404 ELSE 200 END AS status",
    "value AS duration_ms",
    "CASE WHEN event_type = 'error' THEN concat('kind_', CAST(user_id % 3 AS STRING)) END AS error_type",
]


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*REQUEST_COLUMNS)


REQUEST_LOG_SQL = f"request_log AS (SELECT {', '.join(REQUEST_COLUMNS)} FROM events)"

# --- raw text with gaps ----------------------------------------------------------------------

# Whole rows, single cells and copies go blank; numbers appear as text in several spellings.
DIRTY_COLUMNS = {
    "name": "CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat(' ', p_name, ' ') END",
    "brand": "CASE WHEN p_partkey % 29 = 0 THEN ' ' WHEN p_partkey % 11 = 0 THEN NULL ELSE p_brand END",
    "size_text": "CASE WHEN p_partkey % 29 = 0 THEN NULL ELSE concat(CAST(p_size AS STRING), '_000') END",
    "price_text": (
        "CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 13 = 0 THEN concat('+', CAST(p_size AS STRING), '.50')"
        " ELSE concat(CAST(p_size AS STRING), 'e1') END"
    ),
    "mixed_text": (
        "CASE WHEN p_partkey % 29 = 0 THEN '' WHEN p_partkey % 5 = 0 THEN concat(CAST(p_size AS STRING), 'd')"
        " ELSE CAST(p_size AS STRING) END"
    ),
}


def dirty_parts(spark: SparkSession, sf_dir: str, *extra: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*extra, *[f"{e} AS {n}" for n, e in DIRTY_COLUMNS.items()])


def dirty_sql(*extra: str) -> str:
    """CTE ``dirty`` with the raw cells, and ``cells`` with them stripped."""
    raw = ", ".join([*extra, *[f"{e} AS {n}" for n, e in DIRTY_COLUMNS.items()]])
    kept = ", ".join([*[x.split(" AS ")[-1] for x in extra], *[f"trim(coalesce({n}, '')) AS {n}" for n in DIRTY_COLUMNS]])
    return f"dirty AS (SELECT {raw} FROM part), cells AS (SELECT {kept} FROM dirty)"


# The number patterns in the form the checking engine's full-match test takes.
INTEGER_SQL = r"[+-]?[0-9]+(_[0-9]+)*"
NUMBER_SQL = (
    r"[+-]?((([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"([eE][+-]?[0-9]+(_[0-9]+)*)?|[iI][nN][fF]|[iI][nN][fF][iI][nN][iI][tT][yY]|[nN][aA][nN])"
)


def inferred_sql(column: str) -> str:
    """Inferred type of a stripped text column, as an aggregate."""
    return (
        f"CASE WHEN COUNT(*) FILTER (WHERE {column} <> '') = 0 THEN 'string' "
        f"WHEN bool_and(regexp_full_match({column}, '{INTEGER_SQL}')) FILTER (WHERE {column} <> '') THEN 'integer' "
        f"WHEN bool_and(regexp_full_match({column}, '{NUMBER_SQL}')) FILTER (WHERE {column} <> '') THEN 'number' "
        "ELSE 'string' END"
    )
