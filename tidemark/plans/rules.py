"""Signal, recommendation, guidance, automation and chart queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators import registry, rules, stats
from tidemark.operators.signals import guidance_signals, recommendation_signals
from tidemark.plans import stand_ins as si
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import SIGNALS_SQL, table
from tidemark.session import scratch_path

OBJECTIVE = "Improve reporting"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- signals -------------------------------------------------------------------------------


@query("workspace_signals", f"WITH {SIGNALS_SQL} SELECT * FROM signals")
def workspace_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.signals(spark, sf_dir)


@query(
    "recommendation_signals",
    f"WITH {SIGNALS_SQL} SELECT workspace_id, {', '.join(fixed.RECOMMENDATION_SIGNALS)} FROM signals",
)
def recommendation_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recommendation_signals(si.signals(spark, sf_dir))


@query("guidance_signals", f"WITH {SIGNALS_SQL} SELECT workspace_id, {', '.join(fixed.GUIDANCE_SIGNALS)} FROM signals")
def guidance_signal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return guidance_signals(si.signals(spark, sf_dir))


# --- recommendations and guidance ----------------------------------------------------------

_RECOMMENDATION_TESTS = {
    "ingestion": "dataset_count = 0",
    "pipeline": "dataset_count > 0 AND pipeline_count = 0",
    "ml": "dataset_count > 0 AND model_count = 0",
    "visualization": "dataset_count > 0 AND dashboard_count = 0",
    "business": "insight_count > 0 AND translation_count = 0",
}


def _recommendation_sql(kind: str) -> str:
    title, priority, rationale, action = (_quoted(t) for t in fixed.RECOMMENDATIONS[kind])
    return (
        f"{title} AS title, '{kind}' AS recommendation_type, {priority} AS priority, {rationale} AS rationale, "
        f"{action} AS action_text, 'open' AS status"
    )


_RECOMMENDATIONS = (
    " UNION ALL ".join(
        f"SELECT workspace_id, {_recommendation_sql(kind)} FROM signals WHERE {test}" for kind, test in _RECOMMENDATION_TESTS.items()
    )
    + f" UNION ALL SELECT workspace_id, {_recommendation_sql('optimization')} FROM signals WHERE NOT ("
    + " OR ".join(f"({t})" for t in _RECOMMENDATION_TESTS.values())
    + ")"
)


@query("workspace_recommendations", f"WITH {SIGNALS_SQL} {_RECOMMENDATIONS}")
def workspace_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.workspace_recommendations(si.signals(spark, sf_dir)).drop("position")


@query(
    "rule_union",
    f"WITH {SIGNALS_SQL}, rows_fired AS ({_RECOMMENDATIONS}) SELECT recommendation_type, priority, COUNT(*) AS workspaces "
    "FROM rows_fired GROUP BY ALL",
)
def rule_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.workspace_recommendations(si.signals(spark, sf_dir))
    return found.groupBy("recommendation_type", "priority").agg(F.count(F.lit(1)).alias("workspaces"))


@query(
    "guidance_plan",
    f"WITH {SIGNALS_SQL} "
    + " UNION ALL ".join(
        f"SELECT workspace_id, 'kpi' AS kind, {_quoted(n)} AS name, {_quoted(t)} AS target, concat({s}, ' {u}') AS current, "
        f"'{OBJECTIVE}' AS objective FROM signals"
        for n, t, s, u in fixed.GUIDANCE_KPIS
    )
    + "".join(
        f" UNION ALL SELECT workspace_id, 'milestone', {_quoted(p)}, {_quoted(g)}, NULL, '{OBJECTIVE}' FROM signals"
        for p, g in fixed.GUIDANCE_MILESTONES
    ),
)
def guidance_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.guidance_plan(si.signals(spark, sf_dir), OBJECTIVE)


_RISK_TESTS = {
    "No source data": "dataset_count = 0",
    "Manual workflows": "pipeline_count = 0",
    "Insight-to-action gap": "insight_count > 0 AND translation_count = 0",
}


@query(
    "guidance_risks",
    f"WITH {SIGNALS_SQL} "
    + " UNION ALL ".join(
        f"SELECT workspace_id, '{name}' AS risk, {_quoted(fixed.GUIDANCE_RISKS[name])} AS mitigation FROM signals WHERE {test}"
        for name, test in _RISK_TESTS.items()
    )
    + f" UNION ALL SELECT workspace_id, 'Operational drift', {_quoted(fixed.GUIDANCE_RISKS['Operational drift'])} FROM signals "
    + "WHERE NOT (" + " OR ".join(f"({t})" for t in _RISK_TESTS.values()) + ")",
)
def guidance_risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.guidance_risks(si.signals(spark, sf_dir)).drop("position")


# --- automation ----------------------------------------------------------------------------

_ACTION_TESTS = {
    "Onboard first dataset": "dataset_count = 0",
    "Profile newest dataset": "dataset_count > 0",
    "Define a pipeline cadence": "pipeline_count = 0",
    "Train a starter model": "model_count = 0 AND dataset_count > 0",
    "Translate insights for stakeholders": "insight_count > 0 AND translation_count = 0",
    "Create a working dashboard": "dashboard_count = 0",
    "Activate collaboration": "comment_count = 0 OR share_count = 0",
}
_ACTIONS = "actions AS (" + " UNION ALL ".join(
    f"SELECT workspace_id, {i} AS rule, '{name}' AS name, {_quoted(fixed.AUTOMATION_ACTIONS[name])} AS description FROM signals WHERE {test}"
    for i, (name, test) in enumerate(_ACTION_TESTS.items())
) + "), planned AS (SELECT *, CAST(row_number() OVER (PARTITION BY workspace_id ORDER BY rule) - 1 AS INTEGER) AS position FROM actions)"


@query("automation_actions", f"WITH {SIGNALS_SQL}, {_ACTIONS} SELECT workspace_id, position, name, description FROM planned")
def automation_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.automation_actions(si.signals(spark, sf_dir))


@query(
    "automation_triggers",
    f"WITH {SIGNALS_SQL} SELECT workspace_id, '{fixed.AUTOMATION_TRIGGER[0]}' AS name, '{fixed.AUTOMATION_TRIGGER[1]}' AS condition "
    "FROM signals WHERE dataset_count = 0",
)
def automation_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.signals(spark, sf_dir).select("workspace_id", F.inline(rules.trigger_list()))


_SCORE = "CAST(least(100, 20 + 10 * (dataset_count + pipeline_count + model_count) + 5 * dashboard_count) AS INTEGER)"


@query("automation_score", f"WITH {SIGNALS_SQL} SELECT workspace_id, {_SCORE} AS automation_score FROM signals")
def automation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.signals(spark, sf_dir).select("workspace_id", rules.automation_score().alias("automation_score"))


def _confidence(base: str) -> str:
    return (
        f"ROUND(greatest(0.35::DOUBLE, least(0.98::DOUBLE, {base}::DOUBLE + least(0.18::DOUBLE, dataset_count * 0.03::DOUBLE "
        "+ pipeline_count * 0.02::DOUBLE) - CASE WHEN dataset_count = 0 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END)), 2)"
    )


@query(
    "confidence_score",
    f"WITH {SIGNALS_SQL} SELECT workspace_id, {_confidence('0.62')} AS heuristic, {_confidence('0.74')} AS model FROM signals",
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.signals(spark, sf_dir).select(
        "workspace_id",
        rules.confidence_score(F.lit(fixed.HEURISTIC_PROVIDER)).alias("heuristic"),
        rules.confidence_score(F.lit(fixed.MODEL_PROVIDER)).alias("model"),
    )


_SUMMARY = (
    f"concat('Automation focus: {OBJECTIVE}. The workspace already has ', dataset_count, ' datasets, ', pipeline_count, "
    "' pipelines, and ', model_count, ' trained models, so the next best move is to turn recurring work into tracked automations.')"
)


@query(
    "plan_summary",
    f"WITH {SIGNALS_SQL}, {_ACTIONS}, steps AS (SELECT workspace_id, string_agg(name, '; ' ORDER BY position) FILTER (WHERE position < 4) "
    "AS next_steps, COUNT(*) AS action_count FROM planned GROUP BY workspace_id) "
    f"SELECT s.workspace_id, {_SUMMARY} AS summary, coalesce(next_steps, 'Keep the workspace healthy') AS next_steps, "
    f"CAST(coalesce(action_count, 1) AS INTEGER) AS action_count, {_SCORE} AS automation_score, {_confidence('0.62')} AS confidence_score "
    "FROM signals s LEFT JOIN steps ON steps.workspace_id = s.workspace_id",
)
def plan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = rules.automation_plans(si.signals(spark, sf_dir), OBJECTIVE)
    return plans.select(
        "workspace_id",
        "summary",
        F.array_join("next_steps", "; ").alias("next_steps"),
        F.size("actions").alias("action_count"),
        "automation_score",
        "confidence_score",
    )


@query(
    "grounding_evidence",
    f"WITH {SIGNALS_SQL} SELECT workspace_id, concat_ws('; ', concat('dataset_count=', dataset_count), concat('pipeline_count=', pipeline_count), "
    f"CASE WHEN dashboard_count = 0 THEN '{fixed.NO_DASHBOARDS}' END, "
    f"CASE WHEN model_count = 0 AND dataset_count > 0 THEN '{fixed.NO_MODELS}' END, "
    f"CASE WHEN comment_count = 0 OR share_count = 0 THEN '{fixed.WEAK_COLLABORATION}' END) AS evidence FROM signals",
)
def grounding_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.signals(spark, sf_dir).select(
        "workspace_id", F.array_join(rules.grounding_evidence(), "; ").alias("evidence")
    )


# Action names as people write them, spread over the orders table.
_ACTION_NAME = (
    "CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN 'Onboard first DATASET' WHEN 1 THEN 'Profile newest dataset' "
    "WHEN 2 THEN 'create_dashboard' WHEN 3 THEN 'Train a starter model' WHEN 4 THEN 'Activate Collaboration' "
    "WHEN 5 THEN 'Translate insights for stakeholders' WHEN 6 THEN 'Define a pipeline cadence' "
    "WHEN 7 THEN 'Sharing of the first dataset' ELSE 'unknown_action' END"
)


@query(
    "action_dispatch",
    f"WITH a AS (SELECT o_orderkey, lower({_ACTION_NAME}) AS n FROM orders) SELECT o_orderkey, CASE "
    "WHEN contains(n, 'dataset') AND (contains(n, 'onboard') OR contains(n, 'first')) THEN 'onboard' WHEN contains(n, 'profile') THEN 'profile' "
    "WHEN contains(n, 'dashboard') AND contains(n, 'create') THEN 'dashboard' WHEN contains(n, 'model') AND contains(n, 'train') THEN 'train' "
    "WHEN contains(n, 'collaboration') OR contains(n, 'sharing') THEN 'collaborate' "
    "WHEN contains(n, 'insights') AND contains(n, 'translate') THEN 'translate' WHEN contains(n, 'pipeline') THEN 'cadence' "
    "ELSE 'unmapped' END AS executor FROM a",
)
def action_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_ACTION_NAME} AS action_name")
    return named.select("o_orderkey", rules.action_dispatch(F.col("action_name")).alias("executor"))


def _untranslated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace's first three insights that no translation names (translations point at the next order key)."""
    insights = si.entity(spark, sf_dir, "insight_count").select(
        "workspace_id", F.col("id").alias("insight_id"), F.col("name").alias("title")
    )
    translations = si.entity(spark, sf_dir, "translation_count").select((F.col("id") + 1).alias("insight_id"))
    return registry.untranslated_insights(insights, translations)


_UNTRANSLATED = (
    "first_insights AS (SELECT o_custkey AS workspace_id, o_orderkey AS insight_id, "
    "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n "
    f"FROM orders WHERE {si.ENTITIES['insight_count']}), pending AS (SELECT workspace_id, COUNT(*) AS pending FROM first_insights "
    f"WHERE n <= 3 AND insight_id NOT IN (SELECT o_orderkey + 1 FROM orders WHERE {si.ENTITIES['translation_count']}) GROUP BY workspace_id)"
)

# Plans of generated actions never start from an unknown workspace; one extra plan per order does.
_OUTCOME = (
    "CASE name WHEN 'Onboard first dataset' THEN 'executed' WHEN 'Profile newest dataset' THEN 'executed' "
    "WHEN 'Create a working dashboard' THEN 'executed' WHEN 'Train a starter model' THEN 'deferred' "
    "WHEN 'Activate collaboration' THEN 'executed' WHEN 'Translate insights for stakeholders' THEN 'executed' "
    "WHEN 'Define a pipeline cadence' THEN 'executed' ELSE 'skipped' END"
)


def _planned_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = si.signals(spark, sf_dir)
    plans = rules.automation_plans(state, OBJECTIVE).select(
        F.col("workspace_id").alias("plan_id"),
        "workspace_id",
        F.transform("actions", lambda a: a["name"]).alias("action_names"),
    )
    return rules.action_outcomes(plans, state, _untranslated(spark, sf_dir))


@query(
    "action_outcome",
    f"WITH {SIGNALS_SQL}, {_ACTIONS}, {_UNTRANSLATED}, everything AS (SELECT workspace_id, position, name FROM planned UNION ALL "
    "SELECT workspace_id, 0, 'Keep the workspace healthy' FROM signals WHERE workspace_id NOT IN (SELECT workspace_id FROM planned)) "
    f"SELECT e.workspace_id, e.position, e.name AS action, {_OUTCOME} AS status, "
    "CASE name WHEN 'Train a starter model' THEN 'Model training requires manual dataset selection' "
    "WHEN 'Keep the workspace healthy' THEN 'No executor mapped for this action' ELSE '' END AS reason, "
    "CASE WHEN name = 'Translate insights for stakeholders' THEN coalesce(pending, 0) ELSE -1 END AS translations_created "
    "FROM everything e LEFT JOIN pending p ON p.workspace_id = e.workspace_id",
)
def action_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planned_outcomes(spark, sf_dir).select(
        "workspace_id",
        "position",
        "action",
        "status",
        F.coalesce("reason", F.lit("")).alias("reason"),
        F.coalesce("translations_created", F.lit(-1)).alias("translations_created"),
    )


_SINGLE = (
    "CASE WHEN executor = 'onboard' THEN CASE WHEN coalesce(dataset_count, 0) > 0 THEN 'skipped' WHEN dataset_count IS NULL THEN 'failed' ELSE 'executed' END "
    "WHEN executor = 'profile' THEN CASE WHEN coalesce(dataset_count, 0) > 0 THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'dashboard' THEN CASE WHEN coalesce(dashboard_count, 0) > 0 THEN 'skipped' ELSE 'executed' END "
    "WHEN executor = 'train' THEN CASE WHEN coalesce(model_count, 0) > 0 THEN 'skipped' ELSE 'deferred' END "
    "WHEN executor = 'collaborate' THEN CASE WHEN coalesce(dashboard_count, 0) > 0 THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'translate' THEN CASE WHEN coalesce(insight_count, 0) > 0 THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'cadence' THEN CASE WHEN coalesce(pipeline_count, 0) > 0 THEN 'skipped' ELSE 'executed' END ELSE 'skipped' END"
)
_EXECUTOR = (
    "CASE CAST(o_orderkey % 9 AS INTEGER) WHEN 0 THEN 'onboard' WHEN 1 THEN 'profile' WHEN 2 THEN 'dashboard' WHEN 3 THEN 'train' "
    "WHEN 4 THEN 'collaborate' WHEN 5 THEN 'translate' WHEN 6 THEN 'cadence' WHEN 7 THEN 'onboard' ELSE 'unmapped' END"
)


@query(
    "action_outcome_single",
    f"WITH {SIGNALS_SQL}, plans AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS workspace_id, "
    f"{_EXECUTOR} AS executor FROM orders) SELECT p.plan_id, p.workspace_id, p.executor, {_SINGLE} AS status "
    "FROM plans p LEFT JOIN signals s ON s.workspace_id = p.workspace_id",
)
def action_outcome_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS plan_id",
        "CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS workspace_id",
        f"array({_ACTION_NAME}) AS action_names",
    )
    found = rules.action_outcomes(plans, si.signals(spark, sf_dir), _untranslated(spark, sf_dir))
    return found.select("plan_id", "workspace_id", "executor", "status")


_EARLIER = "bool_or(p.executor = '{kind}') OVER (PARTITION BY p.workspace_id ORDER BY plan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_IN_ORDER = (
    "CASE WHEN executor = 'onboard' THEN CASE WHEN datasets > 0 OR (onboarded AND listed) THEN 'skipped' WHEN NOT listed THEN 'failed' ELSE 'executed' END "
    "WHEN executor = 'profile' THEN CASE WHEN datasets > 0 OR (onboarded AND listed) THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'dashboard' THEN CASE WHEN boards > 0 OR boarded THEN 'skipped' ELSE 'executed' END "
    "WHEN executor = 'train' THEN CASE WHEN models > 0 THEN 'skipped' ELSE 'deferred' END "
    "WHEN executor = 'collaborate' THEN CASE WHEN boards > 0 OR boarded THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'translate' THEN CASE WHEN insights > 0 THEN 'executed' ELSE 'skipped' END "
    "WHEN executor = 'cadence' THEN CASE WHEN pipelines > 0 OR paced THEN 'skipped' ELSE 'executed' END ELSE 'skipped' END"
)


@query(
    "plan_execution",
    f"WITH {SIGNALS_SQL}, plans AS (SELECT o_orderkey AS plan_id, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS workspace_id, "
    f"{_EXECUTOR} AS executor FROM orders), states AS (SELECT p.*, s.workspace_id IS NOT NULL AS listed, coalesce(dataset_count, 0) AS datasets, "
    "coalesce(dashboard_count, 0) AS boards, coalesce(model_count, 0) AS models, coalesce(insight_count, 0) AS insights, coalesce(pipeline_count, 0) AS pipelines, "
    + ", ".join(f"coalesce({_EARLIER.format(kind=k)}, FALSE) AS {n}" for k, n in (("onboard", "onboarded"), ("dashboard", "boarded"), ("cadence", "paced")))
    + f" FROM plans p LEFT JOIN signals s ON s.workspace_id = p.workspace_id) SELECT plan_id, workspace_id, {_IN_ORDER} AS status, 'completed' AS execution_status, 1 AS actions FROM states",
)
def plan_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans run one after the other in their workspace; the outcome as it is read back from the stored document."""
    plans = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS plan_id",
        "CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE o_custkey END AS workspace_id",
        f"array({_ACTION_NAME}) AS action_names",
    )
    found = rules.action_outcomes(rules.in_workspace_order(plans), si.signals(spark, sf_dir), _untranslated(spark, sf_dir))
    path = scratch_path(spark, "executions")
    rules.execution_results(found).write.parquet(path)
    stored = F.from_json("execution_results_json", "status string, actions_executed array<struct<status:string>>")
    return spark.read.parquet(path).select("plan_id", "workspace_id", stored.alias("s")).select(
        "plan_id", "workspace_id", F.col("s.actions_executed")[0]["status"].alias("status"), F.col("s.status").alias("execution_status"),
        F.size("s.actions_executed").alias("actions"),
    )


@query(
    "action_rows",
    f"WITH {SIGNALS_SQL}, {_UNTRANSLATED} SELECT 'datasets' AS target, COUNT(*) AS new_rows FROM signals WHERE dataset_count = 0 "
    "UNION ALL SELECT 'dashboards', COUNT(*) FROM signals WHERE dashboard_count = 0 "
    "UNION ALL SELECT 'pipelines', COUNT(*) FROM signals WHERE pipeline_count = 0 "
    "UNION ALL SELECT 'shares', COUNT(*) FROM signals WHERE comment_count = 0 OR share_count = 0 "
    "UNION ALL SELECT 'translations', CAST(coalesce(SUM(pending), 0) AS BIGINT) FROM pending JOIN signals USING (workspace_id) "
    "WHERE insight_count > 0 AND translation_count = 0",
)
def action_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    boards = si.entity(spark, sf_dir, "dashboard_count").select("workspace_id", F.col("id").alias("dashboard_id"))
    additions = rules.rows_to_append(_planned_outcomes(spark, sf_dir), boards, _untranslated(spark, sf_dir))
    return registry.total_counts(**additions).select(F.col("name").alias("target"), F.col("total").alias("new_rows"))


# --- charts and translations ---------------------------------------------------------------

# (id, x, y, goal)
CHART_REQUESTS = [
    (1, "o_orderdate", "o_totalprice", "trend"),
    (2, "o_orderpriority", "o_totalprice", "Compare"),
    (3, "o_orderkey", "o_totalprice", "relate"),
    (4, "o_totalprice", None, " Distribution "),
    (5, "o_orderstatus", "o_orderpriority", "compare"),
    (6, "o_orderstatus", "o_totalprice", "distribution"),
    (7, "no_such_column", "o_custkey", "compare"),
    (8, "o_orderstatus", "no_such_column", "compare"),
]
_KINDS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number",
    "o_orderdate": "datetime", "o_orderpriority": "string",
}
_TRY_NUMBER = "COUNT(TRY_CAST({c} AS DOUBLE)) = COUNT(*)"
_KINDS_SQL = "kinds AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS name, "
    + ("CASE WHEN COUNT(*) > 0 THEN 'datetime' END" if k == "datetime" else f"CASE WHEN {_TRY_NUMBER.format(c=c)} THEN 'number' ELSE 'string' END")
    + " AS data_type FROM orders"
    for c, k in _KINDS.items()
) + ")"
_REQUESTS_SQL = "requests AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{x}', {_quoted(y) if y else 'NULL'}, '{g}')" for i, x, y, g in CHART_REQUESTS
) + ") AS t(request_id, x_column, y_column, goal))"
_KINDS_JOINED = (
    "joined AS (SELECT r.request_id, coalesce(x.data_type, 'string') AS x_kind, y.data_type AS y_kind, lower(trim(r.goal)) AS goal "
    "FROM requests r LEFT JOIN kinds x ON x.name = r.x_column LEFT JOIN kinds y ON y.name = r.y_column)"
)
_CHART = (
    "CASE WHEN x_kind = 'datetime' AND y_kind = 'number' THEN 'line' WHEN x_kind = 'string' AND y_kind = 'number' THEN 'bar' "
    "WHEN x_kind = 'number' AND y_kind = 'number' THEN 'scatter' WHEN goal = 'distribution' THEN 'histogram' ELSE 'table' END"
)


def _requests(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHART_REQUESTS, "request_id int, x_column string, y_column string, goal string")


@query(
    "stats_lookup",
    f"WITH {_KINDS_SQL}, {_REQUESTS_SQL}, {_KINDS_JOINED} SELECT request_id, x_kind, coalesce(y_kind, '') AS y_kind FROM joined",
)
def stats_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = stats.column_kinds(table(spark, sf_dir, "orders"))
    return rules.chart_kinds(_requests(spark), kinds).select(
        "request_id", "x_kind", F.coalesce("y_kind", F.lit("")).alias("y_kind")
    )


@query(
    "recommend_chart",
    f"WITH {_KINDS_SQL}, {_REQUESTS_SQL}, {_KINDS_JOINED}, picked AS (SELECT request_id, {_CHART} AS chart_type FROM joined), advice AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS chart_type, {_quoted(r)} AS reason, {_quoted(a)} AS practice_1, {_quoted(b)} AS practice_2"
        for k, (r, a, b) in fixed.CHARTS.items()
    )
    + ") SELECT request_id, chart_type, reason, practice_1, practice_2 FROM picked JOIN advice USING (chart_type)",
)
def recommend_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = stats.column_kinds(table(spark, sf_dir, "orders"))
    return rules.recommend_charts(_requests(spark), kinds).select(
        "request_id", "chart_type", "reason", "practice_1", "practice_2"
    )


@query(
    "business_translation",
    "WITH a AS (SELECT unnest(['executives', 'analysts']) AS audience) SELECT o_orderkey AS insight_id, audience, "
    "concat('For ', audience, ', ''', 'item ', o_orderkey, ''' means: ', o_orderpriority, '. Key impact and recommended actions are described below.') AS summary, "
    f"'{fixed.TRANSLATION_ACTIONS}' AS recommendations_json FROM orders, a WHERE {si.ENTITIES['insight_count']}",
)
def business_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    insights = (
        table(spark, sf_dir, "orders")
        .where(si.ENTITIES["insight_count"])
        .select(
            F.col("o_orderkey").alias("insight_id"),
            F.concat(F.lit("item "), F.col("o_orderkey").cast("string")).alias("title"),
            F.col("o_orderpriority").alias("summary"),
        )
    )
    return rules.translate_insights(insights, ["executives", "analysts"])
