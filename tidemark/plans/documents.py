"""Queries over JSON documents: event details, model replies, graph definitions, stored reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import strip
from tidemark.operators import registry, rules
from tidemark.plans import stand_ins as si
from tidemark.plans.catalog import query
from tidemark.plans.rules import _confidence, _quoted
from tidemark.plans.stand_ins import SIGNALS_SQL, table

# --- event details -------------------------------------------------------------------------

_DETAILS = (
    "CASE CAST(event_id % 7 AS INTEGER) WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '[1, 2]' WHEN 3 THEN concat('not json ', event_type) "
    "WHEN 4 THEN concat('\"', event_type, '\"') ELSE props END"
)


@query(
    "parse_event_details",
    f"WITH d AS (SELECT event_id, event_type, {_DETAILS} AS details, event_id % 7 AS k, props FROM events) SELECT event_id, "
    "CASE WHEN coalesce(details, '') = '' THEN 'empty' WHEN NOT json_valid(details) THEN 'raw' "
    "WHEN json_type(details) = 'OBJECT' THEN 'object' ELSE 'value' END AS details_class, "
    "CASE WHEN coalesce(details, '') = '' THEN '{}' WHEN NOT json_valid(details) THEN concat('{\"raw\":\"', details, '\"}') "
    "WHEN json_type(details) = 'OBJECT' THEN CAST(json(details) AS VARCHAR) ELSE concat('{\"value\":', json(details), '}') END AS details_json FROM d",
)
def parse_event_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").selectExpr("event_id", f"{_DETAILS} AS details")
    return documents.parse_details(events).drop("details")


@query(
    "event_details_values",
    "SELECT event_type, COUNT(*) AS events, COUNT(DISTINCT CAST(json_extract_string(props, '$.k') AS BIGINT)) AS distinct_k, "
    "CAST(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total_k FROM events GROUP BY event_type",
)
def event_details_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = documents.details_map(table(spark, sf_dir, "events").select("event_type", "props"), "props")
    value = F.element_at("details_map", "k").cast("bigint")
    counted = events.groupBy("event_type", value.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("event_type").agg(
        F.sum("n").alias("events"), F.count("k").alias("distinct_k"), F.sum(F.col("k") * F.col("n")).alias("total_k")
    )


# --- model replies -------------------------------------------------------------------------

_REPLY = (
    "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN concat('```json', chr(10), props, chr(10), '```') "
    "WHEN 1 THEN concat('Here you are: ', props, ' Done.') WHEN 2 THEN concat('[', user_id, ']') WHEN 3 THEN concat('{broken ', props) "
    "ELSE 'no object here' END"
)


@query(
    "extract_reply_json",
    f"WITH r AS (SELECT event_id, regexp_extract({_REPLY}, '(\\{{[^\\x00]*\\}})', 1) AS body FROM events) SELECT event_id, "
    "CASE WHEN body <> '' AND json_valid(body) THEN CAST(json(body) AS VARCHAR) ELSE '' END AS payload FROM r",
)
def extract_reply_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "events").selectExpr("event_id", f"{_REPLY} AS reply")
    found = documents.reply_object(replies)
    return found.select("event_id", F.coalesce(F.to_json("payload"), F.lit("")).alias("payload"))


# One reply per workspace, with scores, lists and blanks of every kind.
_PLAN_REPLY = (
    "CASE CAST(c_custkey % 6 AS INTEGER) "
    "WHEN 0 THEN concat('```json', chr(10), '{\"title\": \"Plan ', c_custkey, '\", \"summary\": \"\", \"automation_score\": ', c_custkey, "
    "', \"confidence_score\": \"0.456\", \"actions\": [\"Refresh\", {\"title\": \"Check\", \"detail\": \"Look\"}, 5], \"triggers\": [], "
    "\"next_steps\": [\"One\", \" \", 2]}', chr(10), '```') "
    "WHEN 1 THEN '{\"automation_score\": \"88.9\", \"confidence_score\": 3, \"actions\": [{}], \"next_steps\": \"none\", \"provider_notes\": \"Mine\"}' "
    "WHEN 2 THEN '{\"title\": null, \"automation_score\": \"high\", \"confidence_score\": null, \"actions\": [7, null], \"next_steps\": [\"\"]}' "
    "WHEN 3 THEN '{\"title\": 0, \"summary\": 12, \"automation_score\": -4, \"confidence_score\": -1, "
    "\"actions\": [\"a\", \"b\", \"c\", \"d\", \"e\", \"f\", \"g\"], \"next_steps\": [\"1\", \"2\", \"3\", \"4\", \"5\", \"6\", \"7\"]}' "
    "WHEN 4 THEN 'no reply' ELSE NULL END"
)


@query(
    "normalise_plan",
    f"WITH {SIGNALS_SQL}, p AS (SELECT s.*, CAST(s.workspace_id % 6 AS INTEGER) AS k, "
    f"concat('Automation focus: Improve reporting. The workspace already has ', dataset_count, ' datasets, ', pipeline_count, ' pipelines, and ', model_count, "
    "' trained models, so the next best move is to turn recurring work into tracked automations.') AS auto_summary, "
    "CAST(least(100, 20 + 10 * (dataset_count + pipeline_count + model_count) + 5 * dashboard_count) AS INTEGER) AS auto_score, "
    f"{_confidence('0.62')} AS auto_confidence, {_confidence('0.74')} AS model_confidence FROM signals s) SELECT workspace_id, "
    "CASE k WHEN 0 THEN concat('Plan ', workspace_id) ELSE 'Improve reporting' END AS title, "
    "CASE k WHEN 3 THEN '12' ELSE auto_summary END AS summary, "
    "CASE k WHEN 0 THEN CAST(least(100, workspace_id) AS INTEGER) WHEN 1 THEN 88 WHEN 3 THEN 0 ELSE auto_score END AS automation_score, "
    "CASE k WHEN 0 THEN 0.46::DOUBLE WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN model_confidence WHEN 3 THEN 0.0::DOUBLE ELSE auto_confidence END AS confidence_score, "
    "CASE k WHEN 0 THEN 'Refresh=Refresh; Check=Look' WHEN 1 THEN 'Action item=Action item' WHEN 3 THEN 'a=a; b=b; c=c; d=d; e=e; f=f' ELSE 'rules' END AS actions, "
    "CASE k WHEN 0 THEN 'One; 2' WHEN 3 THEN '1; 2; 3; 4; 5; 6' ELSE 'rules' END AS next_steps, "
    f"CASE WHEN k = 1 THEN 'Mine' WHEN k IN (0, 2, 3) THEN {_quoted(fixed.MODEL_NOTES)} ELSE {_quoted(fixed.HEURISTIC_NOTES)} END AS provider_notes, "
    "CASE WHEN k <= 3 THEN 'lm-studio' ELSE 'heuristic' END AS provider FROM p",
)
def normalise_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    replies = table(spark, sf_dir, "customer").selectExpr("c_custkey AS workspace_id", f"{_PLAN_REPLY} AS reply")
    plans = (
        rules.automation_plans(si.signals(spark, sf_dir), "Improve reporting")
        .withColumn("model_confidence", rules.confidence_score(F.lit(fixed.MODEL_PROVIDER)))
        .withColumns({"rule_actions": F.col("actions"), "rule_steps": F.col("next_steps")})
        .join(replies, "workspace_id")
    )
    done = documents.normalise_plans(plans)
    items = F.array_join(F.transform("actions", lambda a: F.concat(a["name"], F.lit("="), a["description"])), "; ")
    return done.select(
        "workspace_id",
        "title",
        "summary",
        "automation_score",
        "confidence_score",
        F.when(F.col("actions") == F.col("rule_actions"), "rules").otherwise(items).alias("actions"),
        F.when(F.col("next_steps") == F.col("rule_steps"), "rules").otherwise(F.array_join("next_steps", "; ")).alias("next_steps"),
        "provider_notes",
        "provider",
    )


_STORED_PLAN = (
    "CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN concat('{\"actions\": [{\"name\": \"', o_orderpriority, '\"}, {\"description\": \"x\"}]}') "
    "WHEN 1 THEN '{\"actions\": \"none\"}' WHEN 2 THEN concat('{broken', o_custkey) ELSE '{\"actions\": []}' END"
)


@query(
    "plan_actions",
    f"WITH p AS (SELECT o_orderkey, o_orderpriority, {_STORED_PLAN} AS doc FROM orders) SELECT o_orderkey, "
    "CASE WHEN json_valid(doc) AND json_type(doc, '$.actions') = 'ARRAY' THEN 'completed' ELSE 'failed' END AS plan_status, "
    f"CASE WHEN NOT json_valid(doc) THEN '{fixed.INVALID_PLAN}' WHEN json_type(doc, '$.actions') <> 'ARRAY' THEN '{fixed.PLAN_WITHOUT_ACTIONS}' ELSE '' END AS plan_reason, "
    "CASE WHEN o_orderkey % 4 = 0 THEN concat(o_orderpriority, ',Unknown') ELSE '' END AS action_names FROM p",
)
def plan_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_STORED_PLAN} AS automation_json")
    return documents.plan_actions(stored).select(
        "o_orderkey", "plan_status", F.coalesce("plan_reason", F.lit("")).alias("plan_reason"),
        F.array_join("action_names", ",").alias("action_names"),
    )


@query(
    "attach_trace",
    f"WITH {SIGNALS_SQL} SELECT workspace_id, 'auto-' AS id_start, TRUE AS has_time, 'heuristic' AS provider, 'Improve reporting' AS objective, "
    "dataset_count, share_count, CAST(2 + (dashboard_count = 0)::INT + (model_count = 0 AND dataset_count > 0)::INT "
    "+ (comment_count = 0 OR share_count = 0)::INT AS INTEGER) AS evidence FROM signals",
)
def attach_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = rules.automation_plans(si.signals(spark, sf_dir), "Improve reporting").withColumn(
        "provider", F.lit(fixed.HEURISTIC_PROVIDER)
    )
    traced = documents.attach_trace(plans, "Improve reporting", rules.grounding_evidence())
    return traced.select(
        "workspace_id",
        F.left("trace.trace_id", F.lit(5)).alias("id_start"),
        F.col("trace.generated_at").isNotNull().alias("has_time"),
        "trace.provider",
        "trace.objective",
        "trace.grounding.signal_snapshot.dataset_count",
        "trace.grounding.signal_snapshot.share_count",
        F.size("trace.grounding.evidence").alias("evidence"),
    )


# --- graph definitions ---------------------------------------------------------------------

# Good and bad definitions, one kind per remainder, with ids from the order.
_DEFINITION = (
    "CASE CAST(o_orderkey % 11 AS INTEGER) "
    "WHEN 0 THEN concat('{\"nodes\": [{\"id\": \"', o_orderkey, '\"}, {\"id\": \"', o_custkey, 'b\"}], \"edges\": [{\"from\": \"', o_orderkey, "
    "'\", \"to\": \"', o_custkey, 'b\"}]}') "
    "WHEN 1 THEN '{\"nodes\": [], \"edges\": []}' "
    "WHEN 2 THEN concat('[', o_orderkey, ']') "
    "WHEN 3 THEN concat('{\"nodes\": [{\"id\": ', o_orderkey, '}], \"edges\": {}}') "
    "WHEN 4 THEN concat('{\"nodes\": [{\"id\": ', o_orderkey, '}, {\"name\": 1}], \"edges\": []}') "
    "WHEN 5 THEN concat('{\"nodes\": [{\"id\": ', o_orderkey, '}], \"edges\": [', o_custkey, ']}') "
    "WHEN 6 THEN concat('{\"nodes\": [{\"id\": 1}, {\"id\": 2}], \"edges\": [{\"from\": 1, \"to\": ', o_orderkey + 10, '}]}') "
    "WHEN 7 THEN '{\"nodes\": [{\"id\": 1}], \"edges\": [{\"from\": 1}]}' "
    "WHEN 8 THEN '{\"nodes\": \"x\", \"edges\": []}' "
    "WHEN 9 THEN concat('{\"edges\": [{\"to\": 1, \"from\": 1}], \"nodes\": [{\"id\": 1}], \"a\": ', o_custkey, '}') "
    "ELSE concat('{\"nodes\": ', o_orderkey) END"
)


@query(
    "validate_definition",
    "WITH d AS (SELECT o_orderkey, o_custkey, CAST(o_orderkey % 11 AS INTEGER) AS k FROM orders) SELECT o_orderkey, CASE k "
    f"WHEN 1 THEN '{fixed.NO_NODES}' WHEN 2 THEN '{fixed.NOT_AN_OBJECT}' WHEN 3 THEN '{fixed.EDGES_NOT_LIST}' "
    f"WHEN 4 THEN '{fixed.NODE_WITHOUT_ID}' WHEN 5 THEN '{fixed.EDGE_NOT_OBJECT}' WHEN 6 THEN '{fixed.EDGE_UNKNOWN_NODE}' "
    f"WHEN 7 THEN '{fixed.EDGE_UNKNOWN_NODE}' WHEN 8 THEN '{fixed.NO_NODES}' WHEN 10 THEN '{fixed.NOT_AN_OBJECT}' ELSE '' END AS problem, "
    "CASE k WHEN 0 THEN concat('{\"edges\":[{\"from\":\"', o_orderkey, '\",\"to\":\"', o_custkey, 'b\"}],\"nodes\":[{\"id\":\"', o_orderkey, "
    "'\"},{\"id\":\"', o_custkey, 'b\"}]}') WHEN 9 THEN concat('{\"a\":', o_custkey, ',\"edges\":[{\"from\":1,\"to\":1}],\"nodes\":[{\"id\":1}]}') "
    "ELSE '' END AS canonical_json FROM d",
)
def validate_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    definitions = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_DEFINITION} AS definition_json")
    return documents.validate_definitions(definitions).select(
        "o_orderkey",
        F.coalesce("problem", F.lit("")).alias("problem"),
        F.coalesce("canonical_json", F.lit("")).alias("canonical_json"),
    )


# --- stored reports ------------------------------------------------------------------------

_REPORT = (
    "CASE WHEN l_linenumber = 1 THEN '{}' WHEN l_linenumber = 2 THEN concat('{\"row_count\": ', l_partkey, ', \"issues\": [\"a\", \"b\"]}') "
    "ELSE concat('{\"row_count\": ', l_partkey, ', \"rejected_rows\": ', l_linenumber, ', \"quality_score\": ', l_suppkey, "
    "', \"columns\": [{\"name\": \"x\", \"missing\": 0, \"sample_size\": 2, \"inferred_type\": \"integer\"}], \"metadata\": {\"v\": 1}}') END"
)


@query(
    "read_quality_report",
    "WITH r AS (SELECT l_orderkey AS dataset_id, l_linenumber, l_partkey, l_suppkey, l_shipdate, "
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS n FROM lineitem), "
    f"j AS (SELECT dataset_id, json({_REPORT}) AS doc FROM r WHERE n = 1) SELECT dataset_id, "
    "coalesce(CAST(json_extract_string(doc, '$.row_count') AS BIGINT), 0) AS row_count, "
    "coalesce(CAST(json_extract_string(doc, '$.rejected_rows') AS BIGINT), 0) AS rejected_rows, "
    "coalesce(CAST(json_extract_string(doc, '$.quality_score') AS INTEGER), 0) AS quality_score, "
    "CAST(coalesce(json_array_length(doc, '$.columns'), 0) AS INTEGER) AS column_count, "
    "CAST(coalesce(json_array_length(doc, '$.issues'), 0) AS INTEGER) AS issue_count, "
    "json_extract(doc, '$.metadata') IS NOT NULL AS has_metadata FROM j",
)
def read_quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    reports = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS dataset_id", "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"
    )
    order = [F.col(c).desc() for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")]
    newest = registry.newest_per_key(reports, ["dataset_id"], order).withColumn("summary_json", F.expr(_REPORT))
    return documents.read_reports(newest).select(
        "dataset_id",
        "row_count",
        "rejected_rows",
        "quality_score",
        F.size("columns").alias("column_count"),
        F.size("issues").alias("issue_count"),
        F.col("metadata").isNotNull().alias("has_metadata"),
    )


# --- scalar helpers ------------------------------------------------------------------------

_MESSY = "concat('  ', upper(source), '__', lang, '--', CAST(doc_id AS STRING), chr(9))"


@query(
    "fn_string",
    "SELECT doc_id, lower(concat(upper(source), '__', lang, '--', doc_id)) AS step, "
    "regexp_replace(concat(upper(source), '__', lang, '--', doc_id), '[-_]+', ' ', 'g') AS spaced, "
    "split_part(concat(upper(source), '__', lang, '--', doc_id), '--', 2) AS last_part FROM documents",
)
def fn_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("messy")
    return table(spark, sf_dir, "documents").selectExpr("doc_id", f"{_MESSY} AS messy").select(
        "doc_id",
        F.lower(strip(text)).alias("step"),
        F.regexp_replace(strip(text), "[-_]+", " ").alias("spaced"),
        F.split_part(strip(text), F.lit("--"), F.lit(2)).alias("last_part"),
    )


_STATED = "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN concat('{\"v\": ', value, '}') WHEN 1 THEN concat('{\"v\": \"', user_id, '\"}') WHEN 2 THEN '{\"v\": true}' WHEN 3 THEN '{\"v\": [1]}' ELSE '{}' END"


@query(
    "fn_math",
    "SELECT event_id, CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN CAST(trunc(greatest(0, least(100, value))) AS INTEGER) "
    "WHEN 1 THEN CAST(least(100, user_id) AS INTEGER) WHEN 2 THEN 1 ELSE -1 END AS score, "
    "CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN ROUND(greatest(0.0::DOUBLE, least(1.0::DOUBLE, value)), 2) "
    "WHEN 1 THEN least(1.0::DOUBLE, user_id::DOUBLE) WHEN 2 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS confidence, ROUND(value / 3, 2) AS third FROM events",
)
def fn_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.try_variant_get(F.try_parse_json("stated"), "$.v", "variant")
    return table(spark, sf_dir, "events").selectExpr("event_id", "value", f"{_STATED} AS stated").select(
        "event_id",
        documents.clamp_score(stated, F.lit(-1)).alias("score"),
        documents.clamp_confidence(stated, F.lit(-1.0)).alias("confidence"),
        F.round(F.col("value") / 3, 2).alias("third"),
    )


@query(
    "fn_time",
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS stamp, TRUE AS is_past FROM events",
)
def fn_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("stamp"),
        (F.col("ts") < F.current_timestamp()).alias("is_past"),
    )


@query("fn_id", "SELECT COUNT(*) AS n, COUNT(*) AS ids FROM orders")
def fn_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.uuid().alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return ids.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))


# --- lists ---------------------------------------------------------------------------------


@query(
    "first_k_items",
    "SELECT doc_id, array_to_string(list_slice(string_split(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), ' '), 1, 4), ' ') AS first_words FROM documents",
)
def first_k_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.lower(F.trim(F.regexp_replace("text", r"\s+", " "))), " ")
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(F.slice(words, 1, fixed.PLAN_STEPS), " ").alias("first_words")
    )
