"""JSON and text documents held in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed
from tidemark.functions.cells import normalise, to_double


def _is(kind: str, value: Column) -> Column:
    return F.coalesce(F.schema_of_variant(value).startswith(kind), F.lit(False))


def with_json(df: DataFrame, text: str, name: str = "_json") -> DataFrame:
    """Add a text column parsed as variant, null when it is not exactly one JSON value.

    Spark's parser stops after the first value, so the text is parsed inside brackets, where
    anything after the value is an error or a second item. Only text that holds a bracket of
    its own could end the list early; it is parsed once more inside an object.
    """
    cell = F.col(text)
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), cell, F.lit("]"))), "$", "array<variant>")
    named = F.try_parse_json(F.concat(F.lit('{"v":'), cell, F.lit("}")))
    whole = ~cell.contains("]") | named.isNotNull()
    return (
        df.withColumn("_listed", listed)
        .withColumn(name, F.when((F.size("_listed") == 1) & whole, F.get("_listed", F.lit(0))))
        .drop("_listed")
    )


def parse_details(df: DataFrame, text: str = "details") -> DataFrame:
    """Add details_class (empty, object, value or raw) and details_json, always a JSON object."""
    cell, value, kind = F.col(text), F.col("_json"), F.col("details_class")
    return (
        with_json(df, text)
        .withColumn(
            "details_class",
            F.when(F.coalesce(cell, F.lit("")) == "", "empty")
            .when(value.isNull(), "raw")
            .when(_is("OBJECT", value), "object")
            .otherwise("value"),
        )
        .withColumn(
            "details_json",
            F.when(kind == "empty", F.lit("{}"))
            .when(kind == "raw", F.to_json(F.struct(cell.alias("raw"))))
            .when(kind == "object", F.to_json(value))
            .otherwise(F.concat(F.lit('{"value":'), F.to_json(value), F.lit("}"))),
        )
        .drop("_json")
    )


def details_map(df: DataFrame, text: str = "details") -> DataFrame:
    """Add details_map: details as map<string,string>."""
    parsed = parse_details(df, text)
    return parsed.withColumn("details_map", F.from_json("details_json", "map<string,string>"))


def reply_object(df: DataFrame, text: str = "reply", name: str = "payload") -> DataFrame:
    """Add the JSON object between a reply's first and last brace, as variant; null when there is none.

    Code fences and a language tag lie outside the braces, so they need no step of their own.
    """
    body = F.regexp_extract(text, fixed.BRACED_PATTERN, 1)
    parsed = with_json(df.withColumn("_body", F.when(body != "", body)), "_body", "_value")
    return parsed.withColumn(name, F.when(_is("OBJECT", F.col("_value")), F.col("_value"))).drop("_body", "_value")


def _text(value: Column) -> Column:
    """A variant as text: strings bare, everything else as JSON."""
    return F.when(_is("STRING", value), F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))


def _truthy_text(value: Column) -> Column:
    """Text of a variant that counts as true; null for null, "", 0, false, [] and {}."""
    text = _text(value)
    plain = _is("STRING", value)
    empty = F.when(plain, text == "").otherwise(
        text.isin("null", "false", "[]", "{}") | F.coalesce(text.try_cast("double") == 0, F.lit(False))
    )
    return F.when(value.isNotNull() & ~empty, text)


def _field(payload: Column, name: str) -> Column:
    return F.try_variant_get(payload, f"$.{name}", "variant")


def _first_text(item: Column, *names: str) -> Column:
    return F.coalesce(*[_truthy_text(_field(item, n)) for n in names])


def _number(value: Column) -> Column:
    text = F.to_json(value)
    return (
        F.when(_is("STRING", value), to_double(normalise(F.try_variant_get(value, "$", "string"))))
        .when(text == "true", F.lit(1.0))
        .when(text == "false", F.lit(0.0))
        .otherwise(to_double(text))
    )


def clamp_score(value: Column, fallback: Column) -> Column:
    """Whole score within 0..100, or the fallback when the value is no number."""
    number = _number(value)
    usable = number.isNotNull() & ~F.isnan(number)
    return F.when(usable, F.greatest(F.lit(0.0), F.least(F.lit(100.0), number)).cast("int")).otherwise(fallback)


def clamp_confidence(value: Column, fallback: Column) -> Column:
    """Confidence within 0..1 with two decimals, or the fallback."""
    number = _number(value)
    bounded = F.when(F.isnan(number), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), number)))
    return F.when(number.isNotNull(), F.round(bounded, 2)).otherwise(fallback)


def _items(payload: Column, name: str) -> Column:
    return F.slice(F.try_variant_get(payload, f"$.{name}", "array<variant>"), 1, fixed.PLAN_ITEMS)


def normalise_items(payload: Column, name: str, default_name: str, fallback: Column) -> Column:
    """Up to six {name, description} items from strings or objects, or the fallback."""

    def item(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        title = F.coalesce(_first_text(value, "name", "title", "label"), F.lit(default_name))
        detail = F.coalesce(_first_text(value, "description", "condition", "detail"), title)
        return F.when(_is("STRING", value), F.struct(text.alias("name"), text.alias("description"))).when(
            _is("OBJECT", value), F.struct(title.alias("name"), detail.alias("description"))
        )

    found = F.filter(F.transform(_items(payload, name), item), lambda x: x.isNotNull())
    return F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(fallback)


def normalise_strings(payload: Column, name: str, fallback: Column) -> Column:
    """Up to six non-blank strings, or the fallback."""
    found = F.filter(F.transform(_items(payload, name), _text), lambda x: normalise(x) != "")
    return F.when(F.size(F.coalesce(found, F.array())) > 0, found).otherwise(fallback)


def normalise_plans(plans: DataFrame, reply: str = "reply") -> DataFrame:
    """Merge model replies into rule-based plans; a plan without a usable reply stays as it is.

    ``plans``: output of ``automation_plans`` plus the reply text and model_confidence, the
    confidence to use when the reply states none.
    """
    raw = F.col("_payload")
    usable = raw.isNotNull()
    triggers = F.transform(
        "triggers", lambda t: F.struct(t["name"].alias("name"), t["condition"].alias("description"))
    )
    fields = {
        "title": F.coalesce(_truthy_text(_field(raw, "title")), F.col("title")),
        "summary": F.coalesce(_truthy_text(_field(raw, "summary")), F.col("summary")),
        "automation_score": F.when(usable, clamp_score(_field(raw, "automation_score"), F.col("automation_score")))
        .otherwise(F.col("automation_score")),
        "confidence_score": F.when(usable, clamp_confidence(_field(raw, "confidence_score"), F.col("model_confidence")))
        .otherwise(F.col("confidence_score")),
        "triggers": normalise_items(raw, "triggers", "Trigger item", triggers),
        "actions": normalise_items(raw, "actions", "Action item", F.col("actions")),
        "next_steps": normalise_strings(raw, "next_steps", F.col("next_steps")),
        "provider_notes": F.when(
            usable, F.coalesce(_truthy_text(_field(raw, "provider_notes")), F.lit(fixed.MODEL_NOTES))
        ).otherwise(F.col("provider_notes")),
        "provider": F.when(usable, fixed.MODEL_PROVIDER).otherwise(fixed.HEURISTIC_PROVIDER),
    }
    return reply_object(plans, reply, "_payload").withColumns(fields).drop("_payload")


def plan_actions(plans: DataFrame, text: str = "automation_json") -> DataFrame:
    """Add action_names, plan_status and plan_reason of stored plans; a plan without a list of actions failed."""
    actions = F.col("_actions")
    names = F.transform(actions, lambda a: F.coalesce(_text(_field(a, "name")), F.lit(fixed.UNKNOWN_ACTION)))
    reason = F.when(F.col("_json").isNull(), fixed.INVALID_PLAN).when(actions.isNull(), fixed.PLAN_WITHOUT_ACTIONS)
    return (
        with_json(plans, text)
        .withColumn("_actions", F.try_variant_get("_json", "$.actions", "array<variant>"))
        .withColumns({"action_names": F.coalesce(names, F.array().cast("array<string>")), "plan_reason": reason})
        .withColumn("plan_status", F.when(F.col("plan_reason").isNull(), "completed").otherwise("failed"))
        .drop("_json", "_actions")
    )


def attach_trace(plans: DataFrame, objective: str, evidence: Column) -> DataFrame:
    """Add trace: id, time, provider, objective, signal snapshot and evidence."""
    snapshot = F.struct(*[F.col(s) for s in fixed.SIGNALS])
    return plans.withColumn(
        "trace",
        F.struct(
            F.concat(F.lit("auto-"), F.uuid()).alias("trace_id"),
            F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("generated_at"),
            F.col("provider"),
            F.lit(objective).alias("objective"),
            F.struct(snapshot.alias("signal_snapshot"), evidence.alias("evidence")).alias("grounding"),
        ),
    )


def validate_definitions(definitions: DataFrame, text: str = "definition_json") -> DataFrame:
    """Add problem (the first check that fails, null when valid) and canonical_json (valid ones only)."""
    document, nodes, edges, ids = (F.col(n) for n in ("_json", "_nodes", "_edges", "_ids"))

    def ident(value: Column, name: str) -> Column:
        found = _field(value, name)
        return F.when(~F.is_variant_null(found), F.to_json(found))

    node_ids = F.transform(F.filter(nodes, lambda n: _is("OBJECT", n)), lambda n: ident(n, "id"))
    ends = F.flatten(F.transform(edges, lambda e: F.array(ident(e, "from"), ident(e, "to"))))
    # Nodes have ids by the time ends are compared, so an end without one counts as unknown too.
    unknown = F.size(F.array_except(ends, ids)) > 0
    problem = (
        F.when(document.isNull() | ~_is("OBJECT", document), fixed.NOT_AN_OBJECT)
        .when(F.coalesce(F.size(nodes), F.lit(0)) <= 0, fixed.NO_NODES)
        .when(edges.isNull(), fixed.EDGES_NOT_LIST)
        .when(F.exists(ids, lambda i: i.isNull()), fixed.NODE_WITHOUT_ID)
        .when(F.exists(edges, lambda e: ~_is("OBJECT", e)), fixed.EDGE_NOT_OBJECT)
        .when(unknown, fixed.EDGE_UNKNOWN_NODE)
    )
    return (
        with_json(definitions, text)
        .withColumns(
            {
                "_nodes": F.try_variant_get("_json", "$.nodes", "array<variant>"),
                "_edges": F.try_variant_get("_json", "$.edges", "array<variant>"),
            }
        )
        .withColumn("_ids", node_ids)
        .withColumn("problem", problem)
        .withColumn("canonical_json", F.when(F.col("problem").isNull(), F.to_json("_json")))
        .drop("_json", "_nodes", "_edges", "_ids")
    )


REPORT_SCHEMA = (
    "row_count bigint, rejected_rows bigint, quality_score int, "
    "columns array<struct<name:string,missing:bigint,sample_size:bigint,inferred_type:string>>, "
    "issues array<string>, metadata string"
)


def read_reports(reports: DataFrame, text: str = "summary_json") -> DataFrame:
    """Unpack stored profiles; missing counts are 0, missing lists empty, missing metadata null."""
    return reports.withColumn("_r", F.from_json(text, REPORT_SCHEMA)).withColumns(
        {
            "row_count": F.coalesce("_r.row_count", F.lit(0)),
            "rejected_rows": F.coalesce("_r.rejected_rows", F.lit(0)),
            "quality_score": F.coalesce("_r.quality_score", F.lit(0)),
            "columns": F.coalesce("_r.columns", F.array()),
            "issues": F.coalesce("_r.issues", F.array()),
            "metadata": F.col("_r.metadata"),
        }
    ).drop("_r")
