"""Texts, patterns and limits that results must reproduce exactly."""

# --- whitespace removed from both ends of a cell (the characters str.strip() removes)
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- number patterns
INTEGER_PATTERN = r"^[+-]?[0-9]+(_[0-9]+)*$"
NUMBER_PATTERN = (
    r"(?i)^[+-]?((([0-9]+(_[0-9]+)*)(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)"
    r"(e[+-]?[0-9]+(_[0-9]+)*)?|inf|infinity|nan)$"
)
BRACED_PATTERN = r"(?s)(\{.*\})"

# --- limits
ROW_CAP = 1000
QUERY_SECONDS = 5.0
PAGE_DEFAULT = 50
PAGE_MAXIMUM = 1000
EVENT_PAGE_DEFAULT = 100
EVENT_PAGE_MAXIMUM = 500
LATENCY_SAMPLES = 200
RECENT_SHOWN = 20
BUSIEST_PATHS = 10
PREVIEW_ROWS = 5
SUGGESTED_COLUMNS = 5
SUGGESTED_LIMIT = 25
RECENT_DATASETS = 3
PLAN_ITEMS = 6
PLAN_STEPS = 4
OVERFIT_GAP = 0.15
PROFILE_VERSION = "1.1"

# --- gate messages
NAME_REQUIRED = "Dataset name is required"
CSV_ONLY = "Only CSV uploads are supported in the MVP"
EMPTY_DATASET = "Empty dataset"

# --- access review
NO_MEMBERSHIP = "No workspace membership found for user"
WRONG_ROLE = "Insufficient workspace role: "

# --- definition checks, in the order they are made
NOT_AN_OBJECT = "Pipeline definition must be a JSON object"
NO_NODES = "Pipeline definition must include at least one node"
EDGES_NOT_LIST = "Pipeline definition edges must be a list"
NODE_WITHOUT_ID = "Each pipeline node must include an id"
EDGE_NOT_OBJECT = "Each pipeline edge must be an object"
EDGE_UNKNOWN_NODE = "Pipeline edges must reference existing nodes"

# --- workspace summary
UPLOAD_FIRST = "Upload a CSV to create the first dataset and unlock query analysis."

# --- recommendations: type -> (title, priority, rationale, action)
RECOMMENDATIONS = {
    "ingestion": (
        "Ingest your first dataset",
        "high",
        "No datasets are available, so analytics and ML cannot run.",
        "Use the ingestion endpoint to upload a CSV and create a baseline profile.",
    ),
    "pipeline": (
        "Create a repeatable pipeline",
        "high",
        "Data exists but no pipeline orchestrates repeatable transformations.",
        "Create a pipeline with ingest, quality check, and transform steps.",
    ),
    "ml": (
        "Train a baseline model",
        "medium",
        "You have data but no trained model to generate predictive insights.",
        "Train a first classification or regression model on your highest-value dataset.",
    ),
    "visualization": (
        "Publish an executive dashboard",
        "medium",
        "Dashboards make trends and KPIs visible to stakeholders.",
        "Create a dashboard and add at least one chart recommendation to communicate performance.",
    ),
    "business": (
        "Translate insights to business language",
        "medium",
        "Insights exist but no business framing is stored for decision-makers.",
        "Generate business translations for top insights and share with executives.",
    ),
    "optimization": (
        "Optimize model and pipeline quality",
        "low",
        "Core capabilities are in place; now focus on quality and operational maturity.",
        "Add monitoring, drift checks, and regular retraining schedules for production readiness.",
    ),
}

# --- guidance: (name, target, signal, unit), (phase, goal), risk -> mitigation
GUIDANCE_KPIS = [
    ("Data readiness", "95% datasets profiled", "dataset_count", "datasets"),
    ("Pipeline automation", "Daily scheduled flows", "pipeline_count", "pipelines"),
    ("Model adoption", "At least 1 production model", "model_count", "models"),
]
GUIDANCE_MILESTONES = [
    ("30 days", "Stabilize ingestion and data quality"),
    ("60 days", "Operationalize analytics and pipelines"),
    ("90 days", "Scale ML and business narrative distribution"),
]
GUIDANCE_RISKS = {
    "No source data": "Prioritize onboarding at least one core dataset",
    "Manual workflows": "Create repeatable pipeline definitions and schedules",
    "Insight-to-action gap": "Generate business translations for key insights",
    "Operational drift": "Monitor data quality and model performance continuously",
}

# --- automation actions: name -> description
AUTOMATION_ACTIONS = {
    "Onboard first dataset": "Create a repeatable ingestion path for a core CSV or source system.",
    "Profile newest dataset": "Run quality checks and confirm null, type, and shape patterns.",
    "Define a pipeline cadence": "Convert recurring work into a scheduled pipeline with versioning.",
    "Train a starter model": "Use one curated dataset to validate ML signal quality and baseline performance.",
    "Translate insights for stakeholders": "Turn technical findings into business-language summaries and recommendations.",
    "Create a working dashboard": "Build a dashboard shell that can hold key metrics and executive views.",
    "Activate collaboration": "Add comments and sharing so decisions are visible and auditable.",
    "Keep the workspace healthy": "Review data quality, scheduled jobs, and model drift on a regular cadence.",
}
AUTOMATION_TRIGGER = ("Dataset absence", "No datasets registered in the workspace.")
HEURISTIC_NOTES = "Generated without a local model because no LM Studio response was available."
MODEL_NOTES = "Generated by a local LM Studio-compatible model."
HEURISTIC_PROVIDER = "heuristic"
MODEL_PROVIDER = "lm-studio"

# --- evidence lines
NO_DASHBOARDS = "No dashboards found; recommend operational dashboard baseline"
NO_MODELS = "Datasets exist without trained models; recommend baseline model training"
WEAK_COLLABORATION = "Collaboration signal is weak; recommend comments/sharing activation"

# --- plan and action outcomes
INVALID_PLAN = "Invalid automation_json payload"
PLAN_WITHOUT_ACTIONS = "No actions found in plan"
UNKNOWN_ACTION = "Unknown"
UNMAPPED_ACTION = "No executor mapped for this action"
HAS_DATASETS = "Workspace already has datasets"
WORKSPACE_MISSING = "Workspace not found"
NO_DATASETS = "No datasets in workspace"
HAS_DASHBOARDS = "Workspace already has dashboards"
NO_DASHBOARD_TO_SHARE = "No dashboard to share"
HAS_MODELS = "Workspace already has models"
MODEL_NEEDS_CHOICE = "Model training requires manual dataset selection"
NO_INSIGHTS = "No insights to translate"
HAS_PIPELINES = "Workspace already has pipelines"

# --- rows an executed action adds
SAMPLE_DATASET_NAME = "Sample Dataset"
SAMPLE_DATASET_PATH = "/data/raw/ws%s_sample.csv"
GENERATED_DASHBOARD = ("Automation-Generated Dashboard", "Default dashboard created by automation plan execution.")
GENERATED_PIPELINE = ("Automation-Generated Pipeline", "Default pipeline created by automation execution.")
DEFAULT_SHARE = ("dashboard", "team@example.local", "view")
DEFAULT_TRANSLATION = ("stakeholders", "Business context: ", '["Review findings"]')

# --- charts: type -> (reason, practice 1, practice 2)
CHARTS = {
    "line": (
        "Time series data is best read as a trend over time.",
        "Keep the time axis ordered",
        "Avoid dual axes unless absolutely necessary",
    ),
    "bar": (
        "Categorical comparisons are clearest in a bar chart.",
        "Sort bars by value when comparing ranks",
        "Limit the number of categories",
    ),
    "scatter": (
        "Numeric-to-numeric relationships are best shown as a scatter plot.",
        "Check for outliers before plotting",
        "Use transparency for dense point clouds",
    ),
    "histogram": (
        "Distribution analysis is easiest to understand as a histogram.",
        "Use sensible bin widths",
        "Annotate skew and outliers",
    ),
    "table": (
        "The provided structure is not strong enough for a more specialized chart.",
        "Prefer clarity over decoration",
        "Call out any missing values or caveats",
    ),
}

# --- business translation
TRANSLATION_ACTIONS = '[{"action": "investigate", "reason": "insight requires follow-up"}]'

# --- signal names, in report order
SIGNALS = [
    "dataset_count",
    "dashboard_count",
    "pipeline_count",
    "model_count",
    "insight_count",
    "translation_count",
    "comment_count",
    "share_count",
    "guidance_count",
]
RECOMMENDATION_SIGNALS = [
    "dataset_count",
    "pipeline_count",
    "model_count",
    "dashboard_count",
    "insight_count",
    "translation_count",
]
GUIDANCE_SIGNALS = ["dataset_count", "pipeline_count", "model_count", "insight_count", "translation_count"]
