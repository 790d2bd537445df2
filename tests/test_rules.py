"""Rules over workspace signals, charts and translations."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators import registry, rules
from tidemark.operators.signals import workspace_signals


def signals(spark, **counts):
    row = {name: counts.get(name, 0) for name in fixed.SIGNALS}
    return spark.createDataFrame([(1, *row.values())], "workspace_id bigint, " + ", ".join(f"{n} bigint" for n in row))


def test_signals_count_every_table_and_default_to_zero(spark):
    workspaces = spark.createDataFrame([(1,), (2,)], "workspace_id bigint")
    rows = spark.createDataFrame([(1,), (1,), (3,)], "workspace_id bigint")
    got = workspace_signals(workspaces, {"dataset_count": rows, "share_count": rows.limit(0)}).collect()
    assert sorted(tuple(r) for r in got) == [(1, 2, 0), (2, 0, 0)]


def test_new_workspace(spark):
    row = rules.workspace_recommendations(signals(spark)).collect()
    assert [r["title"] for r in row] == ["Ingest your first dataset"]
    assert row[0]["status"] == "open" and row[0]["priority"] == "high"


def test_maturing_workspace(spark):
    rows = rules.workspace_recommendations(signals(spark, dataset_count=1, insight_count=1)).collect()
    assert [r["recommendation_type"] for r in rows] == ["pipeline", "ml", "visualization", "business"]


def test_default_recommendation(spark):
    full = signals(spark, dataset_count=1, pipeline_count=1, model_count=1, dashboard_count=1)
    assert [r["recommendation_type"] for r in rules.workspace_recommendations(full).collect()] == ["optimization"]


@pytest.mark.parametrize(
    ("counts", "confidence", "score"),
    [
        ({}, 0.54, 20),
        ({"dataset_count": 6}, 0.8, 80),
        ({"dataset_count": 1, "pipeline_count": 1, "model_count": 1, "dashboard_count": 1}, 0.67, 55),
        ({"dataset_count": 50}, 0.8, 100),
    ],
)
def test_scores(spark, counts, confidence, score):
    row = rules.automation_plans(signals(spark, **counts), "Goal").first()
    assert (row["confidence_score"], row["automation_score"]) == (confidence, score)


def test_plan_of_new_workspace(spark):
    row = rules.automation_plans(signals(spark), "Goal").first()
    assert [a["name"] for a in row["actions"]] == [
        "Onboard first dataset", "Define a pipeline cadence", "Create a working dashboard", "Activate collaboration"
    ]
    assert row["next_steps"] == [a["name"] for a in row["actions"]]
    assert row["triggers"][0]["name"] == "Dataset absence"
    assert row["summary"].startswith("Automation focus: Goal. The workspace already has 0 datasets, 0 pipelines, and 0 trained")


def outcomes(spark, names, state, workspace=1):
    plans = spark.createDataFrame([(9, workspace, names)], "plan_id int, workspace_id bigint, action_names array<string>")
    none = spark.createDataFrame([], "workspace_id bigint, insight_id bigint, title string")
    rows = rules.action_outcomes(plans, state, none).orderBy("position").collect()
    return [(r["action"], r["status"], r["reason"]) for r in rows]


def test_unknown_action_is_skipped(spark):
    assert outcomes(spark, ["unknown_action"], signals(spark)) == [("unknown_action", "skipped", fixed.UNMAPPED_ACTION)]


def test_actions_see_what_earlier_ones_made(spark):
    got = outcomes(
        spark,
        ["Profile newest dataset", "Onboard first dataset", "Profile newest dataset", "Onboard first dataset",
         "Activate collaboration", "Create a working dashboard", "Activate collaboration", "Train a starter model"],
        signals(spark),
    )
    assert [s for _, s, _ in got] == ["skipped", "executed", "executed", "skipped", "skipped", "executed", "executed", "deferred"]


def test_plans_of_a_workspace_see_what_earlier_plans_made(spark):
    """Two plans that both onboard: the second is skipped; other workspaces don't notice. Results are stored in plan order."""
    rows = [
        (3, 1, ["Profile newest dataset", "Activate collaboration"]), (1, 1, ["Profile newest dataset"]), (2, 1, ["Onboard first dataset", "Create a working dashboard"]),
        (4, 1, ["Onboard first dataset"]), (5, 2, ["Onboard first dataset"]), (6, 2, []), (7, None, ["Define a pipeline cadence"]), (8, None, ["Define a pipeline cadence"]),
    ]
    plans = spark.createDataFrame(rows, "plan_id int, workspace_id bigint, action_names array<string>")
    none = spark.createDataFrame([], "workspace_id bigint, insight_id bigint, title string")
    found = rules.action_outcomes(rules.in_workspace_order(plans), signals(spark), none)
    got = {(r["plan_id"], r["position"]): r["status"] for r in found.collect()}
    assert got == {
        (1, 0): "skipped", (2, 0): "executed", (2, 1): "executed", (3, 0): "executed", (3, 1): "executed", (4, 0): "skipped", (5, 0): "failed",
        (7, 0): "executed", (8, 0): "skipped",
    }
    stored = {r["plan_id"]: r for r in rules.execution_results(found).collect()}
    document = json.loads(stored[2]["execution_results_json"])
    assert document["status"] == stored[2]["execution_status"] == "completed"
    assert [a["status"] for a in document["actions_executed"]] == ["executed", "executed"]
    again = {r["plan_id"]: r["execution_id"] for r in rules.execution_results(found).collect()}
    assert again == {p: r["execution_id"] for p, r in stored.items()} and len(set(again.values())) == len(again)


def test_many_plans_of_one_workspace(spark):
    plans = spark.range(3000).selectExpr("CAST(id AS INT) AS plan_id", "1L AS workspace_id", "array('Onboard first dataset') AS action_names").repartition(5)
    none = spark.createDataFrame([], "workspace_id bigint, insight_id bigint, title string")
    found = rules.action_outcomes(rules.in_workspace_order(plans), signals(spark), none)
    assert [r["plan_id"] for r in found.where("status = 'executed'").collect()] == [0] and found.where("status = 'skipped'").count() == 2999


def test_unlisted_workspace_cannot_be_onboarded(spark):
    assert outcomes(spark, ["Onboard first dataset"], signals(spark), workspace=5) == [
        ("Onboard first dataset", "failed", "Workspace not found")
    ]


@pytest.mark.parametrize(
    ("x", "y", "goal", "chart"),
    [
        ("string", "number", "compare", "bar"), ("categorical", "number", "distribution", "bar"), ("datetime", "number", "", "line"),
        (" Number ", "NUMBER", "x", "scatter"), ("string", None, " Distribution", "histogram"), ("string", "string", "compare", "table"),
    ],
)
def test_charts(spark, x, y, goal, chart):
    df = spark.createDataFrame([(x, y, goal)], "x string, y string, goal string")
    assert df.select(rules.chart_type(F.col("x"), F.col("y"), F.col("goal"))).first()[0] == chart


def test_translation_names_the_audience(spark):
    insight = spark.createDataFrame([(1, "Growth", "Revenue rose")], "insight_id int, title string, summary string")
    row = rules.translate_insights(insight, ["executives"]).first()
    assert row["summary"] == (
        "For executives, 'Growth' means: Revenue rose. Key impact and recommended actions are described below."
    )


def test_summary_of_empty_and_filled_workspaces(spark):
    workspaces = spark.createDataFrame([(1, "a"), (2, "b")], "workspace_id int, name string")
    datasets = spark.createDataFrame([(2, i, f"d{i}", i) for i in range(5)], "workspace_id int, dataset_id int, name string, created_at int")
    members = spark.createDataFrame([(1,), (1,)], "workspace_id int")
    rows = {r["workspace_id"]: r for r in registry.workspace_summary(workspaces, datasets, members).collect()}
    assert rows[1]["next_action"] == fixed.UPLOAD_FIRST and not rows[1]["has_datasets"] and rows[1]["membership_count"] == 2
    assert rows[2]["dataset_count"] == 5 and rows[2]["next_action"] == "Open d4 and run SQL to refine the workspace."
    assert [d["name"] for d in rows[2]["recent_datasets"]] == ["d4", "d3", "d2"]


def test_cut_comes_before_the_translation_check(spark):
    insights = spark.createDataFrame([(1, i) for i in range(5)], "workspace_id int, insight_id int")
    done = spark.createDataFrame([(0,), (1,)], "insight_id int")
    assert [r["insight_id"] for r in registry.untranslated_insights(insights, done).collect()] == [2]


def test_replace_open(spark):
    schema = "workspace_id int, status string"
    old = spark.createDataFrame([(1, "open"), (1, "done"), (2, "open")], schema)
    fresh = spark.createDataFrame([(1, "open"), (1, "open")], schema)
    got = registry.replace_open(old, fresh, spark.createDataFrame([(1,)], "workspace_id int"))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "done"), (1, "open"), (1, "open"), (2, "open")]
