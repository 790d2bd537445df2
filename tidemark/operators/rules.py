"""Rules and text templates over workspace signals, statistics and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.operators.ordered import running_sums
from tidemark.functions.cells import strip

c = F.col


def fired(rules: list[tuple[Column, Column]], default: Column | None = None) -> Column:
    """Array of the values whose condition holds, in rule order; the default alone if none does."""
    hits = F.filter(F.array(*[F.when(test, value) for test, value in rules]), lambda x: x.isNotNull())
    return hits if default is None else F.when(F.size(hits) == 0, F.array(default)).otherwise(hits)


def _pair(first: str, a: str, second: str, b: str) -> Column:
    return F.struct(F.lit(a).alias(first), F.lit(b).alias(second))


# --- recommendations and guidance --------------------------------------------------------


def _recommendation(kind: str) -> Column:
    title, priority, rationale, action = fixed.RECOMMENDATIONS[kind]
    return F.struct(
        F.lit(title).alias("title"),
        F.lit(kind).alias("recommendation_type"),
        F.lit(priority).alias("priority"),
        F.lit(rationale).alias("rationale"),
        F.lit(action).alias("action_text"),
    )


def workspace_recommendations(signals: DataFrame) -> DataFrame:
    """One row per recommendation that applies, with its position in rule order and status open."""
    has_data = c("dataset_count") > 0
    tests = [
        ("ingestion", c("dataset_count") == 0),
        ("pipeline", has_data & (c("pipeline_count") == 0)),
        ("ml", has_data & (c("model_count") == 0)),
        ("visualization", has_data & (c("dashboard_count") == 0)),
        ("business", (c("insight_count") > 0) & (c("translation_count") == 0)),
    ]
    rules = fired([(test, _recommendation(kind)) for kind, test in tests], _recommendation("optimization"))
    return signals.select("workspace_id", F.posexplode(rules).alias("position", "r")).select(
        "workspace_id", "position", "r.*", F.lit("open").alias("status")
    )


def guidance_kpis(signals: DataFrame) -> DataFrame:
    """Three KPI rows per workspace with the current count as text."""
    kpis = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(target).alias("target"),
                F.concat(c(signal).cast("string"), F.lit(f" {unit}")).alias("current"),
            )
            for name, target, signal, unit in fixed.GUIDANCE_KPIS
        ]
    )
    return signals.select("workspace_id", F.inline(kpis))


def guidance_milestones(signals: DataFrame) -> DataFrame:
    """Three milestone rows per workspace."""
    goals = F.array(*[_pair("phase", p, "goal", g) for p, g in fixed.GUIDANCE_MILESTONES])
    return signals.select("workspace_id", F.inline(goals))


def guidance_risks(signals: DataFrame) -> DataFrame:
    """Risks that apply, in rule order, or the default one."""
    risk = {name: _pair("risk", name, "mitigation", m) for name, m in fixed.GUIDANCE_RISKS.items()}
    rules = fired(
        [
            (c("dataset_count") == 0, risk["No source data"]),
            (c("pipeline_count") == 0, risk["Manual workflows"]),
            ((c("insight_count") > 0) & (c("translation_count") == 0), risk["Insight-to-action gap"]),
        ],
        risk["Operational drift"],
    )
    return signals.select("workspace_id", F.posexplode(rules).alias("position", "r")).select(
        "workspace_id", "position", "r.*"
    )


def guidance_plan(signals: DataFrame, objective: str) -> DataFrame:
    """KPIs and milestones of each workspace in one long table: kind, name, target, current."""
    kpis = guidance_kpis(signals).select("workspace_id", F.lit("kpi").alias("kind"), "name", "target", "current")
    goals = guidance_milestones(signals).select(
        "workspace_id",
        F.lit("milestone").alias("kind"),
        c("phase").alias("name"),
        c("goal").alias("target"),
        F.lit(None).cast("string").alias("current"),
    )
    return kpis.unionByName(goals).withColumn("objective", F.lit(objective))


# --- automation plans ----------------------------------------------------------------------


def _action(name: str) -> Column:
    return _pair("name", name, "description", fixed.AUTOMATION_ACTIONS[name])


def _weak_collaboration() -> Column:
    return (c("comment_count") == 0) | (c("share_count") == 0)


def action_list() -> Column:
    """Actions that apply to a signals row, in plan order."""
    has_data = c("dataset_count") > 0
    return fired(
        [
            (~has_data, _action("Onboard first dataset")),
            (has_data, _action("Profile newest dataset")),
            (c("pipeline_count") == 0, _action("Define a pipeline cadence")),
            ((c("model_count") == 0) & has_data, _action("Train a starter model")),
            ((c("insight_count") > 0) & (c("translation_count") == 0), _action("Translate insights for stakeholders")),
            (c("dashboard_count") == 0, _action("Create a working dashboard")),
            (_weak_collaboration(), _action("Activate collaboration")),
        ],
        _action("Keep the workspace healthy"),
    )


def trigger_list() -> Column:
    name, condition = fixed.AUTOMATION_TRIGGER
    return fired([(c("dataset_count") == 0, _pair("name", name, "condition", condition))])


def automation_actions(signals: DataFrame) -> DataFrame:
    """One row per planned action with its position."""
    return signals.select("workspace_id", F.posexplode(action_list()).alias("position", "a")).select(
        "workspace_id", "position", "a.name", "a.description"
    )


def automation_score() -> Column:
    """0-100 maturity score of a signals row."""
    earned = (c("dataset_count") + c("pipeline_count") + c("model_count")) * 10 + c("dashboard_count") * 5 + 20
    return F.least(F.lit(100), earned).cast("int")


def confidence_score(provider: Column) -> Column:
    """Confidence of a plan from a signals row, two decimals."""
    base = F.when(provider == fixed.HEURISTIC_PROVIDER, F.lit(0.62)).otherwise(F.lit(0.74))
    bonus = F.least(F.lit(0.18), c("dataset_count") * F.lit(0.03) + c("pipeline_count") * F.lit(0.02))
    penalty = F.when(c("dataset_count") == 0, F.lit(0.08)).otherwise(F.lit(0.0))
    return F.round(F.greatest(F.lit(0.35), F.least(F.lit(0.98), base + bonus - penalty)), 2)


def plan_summary(objective: Column) -> Column:
    """Plan text with the current counts."""
    return F.format_string(
        "Automation focus: %s. The workspace already has %d datasets, %d pipelines, and %d trained models, "
        "so the next best move is to turn recurring work into tracked automations.",
        objective,
        c("dataset_count"),
        c("pipeline_count"),
        c("model_count"),
    )


def grounding_evidence() -> Column:
    """Two to five evidence lines of a signals row."""
    return fired(
        [
            (F.lit(True), F.concat(F.lit("dataset_count="), c("dataset_count").cast("string"))),
            (F.lit(True), F.concat(F.lit("pipeline_count="), c("pipeline_count").cast("string"))),
            (c("dashboard_count") == 0, F.lit(fixed.NO_DASHBOARDS)),
            ((c("model_count") == 0) & (c("dataset_count") > 0), F.lit(fixed.NO_MODELS)),
            (_weak_collaboration(), F.lit(fixed.WEAK_COLLABORATION)),
        ]
    )


def automation_plans(signals: DataFrame, objective: str) -> DataFrame:
    """The rule-based plan of every workspace as one row: scores, triggers, actions, next steps."""
    goal = F.lit(objective)
    return (
        signals.withColumn("actions", action_list())
        .withColumn("title", goal)
        .withColumn("summary", plan_summary(goal))
        .withColumn("automation_score", automation_score())
        .withColumn("confidence_score", confidence_score(F.lit(fixed.HEURISTIC_PROVIDER)))
        .withColumn("triggers", trigger_list())
        .withColumn("next_steps", F.transform(F.slice("actions", 1, fixed.PLAN_STEPS), lambda a: a["name"]))
        .withColumn("provider_notes", F.lit(fixed.HEURISTIC_NOTES))
    )


# --- running plan actions ------------------------------------------------------------------


def action_dispatch(name: Column) -> Column:
    """Executor for an action name: the first keyword test that holds, or unmapped."""
    text = F.lower(name)
    return (
        F.when(text.contains("dataset") & (text.contains("onboard") | text.contains("first")), "onboard")
        .when(text.contains("profile"), "profile")
        .when(text.contains("dashboard") & text.contains("create"), "dashboard")
        .when(text.contains("model") & text.contains("train"), "train")
        .when(text.contains("collaboration") | text.contains("sharing"), "collaborate")
        .when(text.contains("insights") & text.contains("translate"), "translate")
        .when(text.contains("pipeline"), "cadence")
        .otherwise("unmapped")
    )


EXECUTOR_ACTION = {
    "onboard": "Onboard first dataset",
    "profile": "Profile newest dataset",
    "dashboard": "Create a working dashboard",
    "train": "Train a starter model",
    "collaborate": "Activate collaboration",
    "translate": "Translate insights for stakeholders",
    "cadence": "Define a pipeline cadence",
}


def action_outcomes(plans: DataFrame, signals: DataFrame, untranslated: DataFrame) -> DataFrame:
    """Per plan action: executor, status and reason, judged in plan order.

    ``plans``: plan_id, workspace_id, action_names (array). ``untranslated``: workspace_id, one
    row per insight that would be translated. An action sees what earlier ones in its plan made, and what the
    executors in ``made_before`` made, if ``plans`` has that array (see ``in_workspace_order``).
    """
    if "made_before" not in plans.columns:
        plans = plans.withColumn("made_before", F.array().cast("array<string>"))
    pending = untranslated.groupBy("workspace_id").agg(F.count(F.lit(1)).alias("pending"))
    state = signals.withColumn("listed", F.lit(True))
    rows = (
        plans.withColumn("executors", F.transform("action_names", action_dispatch))
        .join(state, "workspace_id", "left")
        .join(pending, "workspace_id", "left")
        .na.fill(0, [*fixed.SIGNALS, "pending"])
        .na.fill({"listed": False})
        .select("*", F.posexplode("action_names").alias("position", "action_name"))
    )
    executor = F.element_at("executors", c("position") + 1)
    earlier = F.concat("made_before", F.slice("executors", F.lit(1), c("position")))

    def before(kind: str) -> Column:
        return F.array_contains(earlier, kind)

    has_data = (c("dataset_count") > 0) | (before("onboard") & c("listed"))
    has_board = (c("dashboard_count") > 0) | before("dashboard")
    has_cadence = (c("pipeline_count") > 0) | before("cadence")

    def verdict(status: str, reason: str | None = None) -> Column:
        return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"))

    outcome = (
        F.when(
            c("executor") == "onboard",
            F.when(has_data, verdict("skipped", fixed.HAS_DATASETS))
            .when(~c("listed"), verdict("failed", fixed.WORKSPACE_MISSING))
            .otherwise(verdict("executed")),
        )
        .when(
            c("executor") == "profile",
            F.when(has_data, verdict("executed")).otherwise(verdict("skipped", fixed.NO_DATASETS)),
        )
        .when(
            c("executor") == "dashboard",
            F.when(has_board, verdict("skipped", fixed.HAS_DASHBOARDS)).otherwise(verdict("executed")),
        )
        .when(
            c("executor") == "train",
            F.when(c("model_count") > 0, verdict("skipped", fixed.HAS_MODELS)).otherwise(
                verdict("deferred", fixed.MODEL_NEEDS_CHOICE)
            ),
        )
        .when(
            c("executor") == "collaborate",
            F.when(has_board, verdict("executed")).otherwise(verdict("skipped", fixed.NO_DASHBOARD_TO_SHARE)),
        )
        .when(
            c("executor") == "translate",
            F.when(c("insight_count") > 0, verdict("executed")).otherwise(verdict("skipped", fixed.NO_INSIGHTS)),
        )
        .when(
            c("executor") == "cadence",
            F.when(has_cadence, verdict("skipped", fixed.HAS_PIPELINES)).otherwise(verdict("executed")),
        )
        .otherwise(verdict("skipped", fixed.UNMAPPED_ACTION))
    )
    known = F.create_map(*[F.lit(x) for pair in EXECUTOR_ACTION.items() for x in pair])
    return (
        rows.withColumn("executor", executor)
        .withColumn("outcome", outcome)
        .select(
            "plan_id",
            "workspace_id",
            "position",
            F.coalesce(F.try_element_at(known, c("executor")), c("action_name")).alias("action"),
            "executor",
            "outcome.status",
            "outcome.reason",
            F.when((c("executor") == "translate") & (c("insight_count") > 0),
                   F.when(before("translate"), F.lit(0)).otherwise(c("pending"))).alias("translations_created"),
        )
    )


#: Executors whose work later actions find done.
LASTING = ("onboard", "dashboard", "cadence", "translate")


def in_workspace_order(plans: DataFrame) -> DataFrame:
    """``plans`` with ``made_before``: the lasting executors that earlier plans of the workspace have run, by ascending plan_id.

    Each plan is summed up in one row; running sums over range partitions carry the sums along a workspace, however many plans it has.
    """
    executors = F.transform("action_names", action_dispatch)
    sums = plans.select("plan_id", "workspace_id", *[F.array_contains(executors, kind).cast("int").alias(kind) for kind in LASTING])
    sums = running_sums(sums, ["workspace_id"], ["plan_id"], list(LASTING))
    made = F.array_compact(F.array(*[F.when(c(f"before_{kind}") > 0, kind) for kind in LASTING]))
    made = sums.select(c("plan_id").alias("_plan"), made.alias("made_before"))
    return plans.join(made, c("plan_id") == c("_plan")).drop("_plan")


def execution_results(outcomes: DataFrame) -> DataFrame:
    """plan_id, workspace_id, execution_id, execution_status, execution_results_json: what is stored of every executed plan.

    The document lists the plan's actions in order. The id follows from plan and document, so running a plan again
    under the same circumstances replaces its row.
    """
    entry = F.struct("position", F.struct("action", "status", "reason", "translations_created").alias("result"))
    plans = outcomes.groupBy("plan_id", "workspace_id").agg(F.sort_array(F.collect_list(entry)).alias("actions"))
    document = F.to_json(F.struct(F.lit("completed").alias("status"), c("actions.result").alias("actions_executed")))
    stored = plans.select("plan_id", "workspace_id", F.lit("completed").alias("execution_status"), document.alias("execution_results_json"))
    return stored.withColumn("execution_id", F.xxhash64("plan_id", "execution_results_json"))


def rows_to_append(outcomes: DataFrame, dashboards: DataFrame, untranslated: DataFrame) -> dict[str, DataFrame]:
    """Registry rows the executed actions add: datasets, dashboards, pipelines, shares, translations.

    ``dashboards``: workspace_id, dashboard_id. ``untranslated``: workspace_id, insight_id, title.
    A share of a dashboard made by the same plan has no resource_id until that row is stored.
    """
    done = outcomes.where("status = 'executed'")
    board_name, board_text = fixed.GENERATED_DASHBOARD
    cadence_name, cadence_text = fixed.GENERATED_PIPELINE
    kind, target, permission = fixed.DEFAULT_SHARE
    audience, prefix, actions = fixed.DEFAULT_TRANSLATION
    first_board = dashboards.groupBy("workspace_id").agg(F.min("dashboard_id").alias("resource_id"))
    translating = done.where("executor = 'translate'").select("workspace_id").distinct()
    return {
        "datasets": done.where("executor = 'onboard'").select(
            "workspace_id",
            F.lit(fixed.SAMPLE_DATASET_NAME).alias("name"),
            F.lit("file").alias("source_type"),
            F.format_string(fixed.SAMPLE_DATASET_PATH, c("workspace_id").cast("string")).alias("storage_path"),
        ),
        "dashboards": done.where("executor = 'dashboard'").select(
            "workspace_id", F.lit(board_name).alias("name"), F.lit(board_text).alias("description")
        ),
        "pipelines": done.where("executor = 'cadence'").select(
            "workspace_id", F.lit(cadence_name).alias("name"), F.lit(cadence_text).alias("description")
        ),
        "shares": done.where("executor = 'collaborate'")
        .join(first_board, "workspace_id", "left")
        .select(
            "workspace_id",
            F.lit(kind).alias("resource_type"),
            "resource_id",
            F.lit(target).alias("target_email"),
            F.lit(permission).alias("permission"),
        ),
        "translations": untranslated.join(translating, "workspace_id", "left_semi").select(
            "workspace_id",
            "insight_id",
            F.lit(audience).alias("audience"),
            F.concat(F.lit(prefix), c("title")).alias("summary"),
            F.lit(actions).alias("recommendations_json"),
        ),
    }


# --- charts and translations -----------------------------------------------------------------


def chart_type(x_kind: Column, y_kind: Column, goal: Column) -> Column:
    """Chart for two column kinds and a goal; the first rule that holds decides."""
    x, y, wanted = F.lower(strip(x_kind)), F.lower(strip(F.coalesce(y_kind, F.lit("")))), F.lower(strip(goal))
    return (
        F.when((x == "datetime") & (y == "number"), "line")
        .when(x.isin("string", "categorical") & (y == "number"), "bar")
        .when((x == "number") & (y == "number"), "scatter")
        .when(wanted == "distribution", "histogram")
        .otherwise("table")
    )


def chart_kinds(requests: DataFrame, kinds: DataFrame) -> DataFrame:
    """Add x_kind (string when unknown) and y_kind (null when unknown) to chart requests.

    ``requests``: request_id, x_column, y_column, goal. ``kinds``: name, data_type.
    """
    x = kinds.select(F.col("name").alias("x_column"), F.col("data_type").alias("x_kind"))
    y = kinds.select(F.col("name").alias("y_column"), F.col("data_type").alias("y_kind"))
    return (
        requests.join(x, "x_column", "left").join(y, "y_column", "left")
        .withColumn("x_kind", F.coalesce("x_kind", F.lit("string")))
    )


def recommend_charts(requests: DataFrame, kinds: DataFrame) -> DataFrame:
    """Chart, reason and two practices for every request."""
    advice = F.create_map(
        *[
            x
            for kind, (reason, first, second) in fixed.CHARTS.items()
            for x in (F.lit(kind), F.struct(F.lit(reason).alias("reason"), F.lit(first).alias("practice_1"),
                                            F.lit(second).alias("practice_2")))
        ]
    )
    return (
        chart_kinds(requests, kinds)
        .withColumn("chart_type", chart_type(c("x_kind"), c("y_kind"), c("goal")))
        .withColumn("advice", F.element_at(advice, c("chart_type")))
        .select("request_id", "x_kind", "y_kind", "chart_type", "advice.*")
    )


def translate_insights(insights: DataFrame, audiences: list[str]) -> DataFrame:
    """Business text per insight and audience. ``insights``: insight_id, title, summary."""
    return insights.select("*", F.explode(F.array(*[F.lit(a) for a in audiences])).alias("audience")).select(
        "insight_id",
        "audience",
        F.concat(
            F.lit("For "), c("audience"), F.lit(", '"), c("title"), F.lit("' means: "), c("summary"),
            F.lit(". Key impact and recommended actions are described below."),
        ).alias("summary"),
        F.lit(fixed.TRANSLATION_ACTIONS).alias("recommendations_json"),
    )
