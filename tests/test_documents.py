"""JSON documents: details, replies, definitions, reports."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import documents
from tidemark.functions import fixed_values as fixed
from tidemark.operators import rules


def one(spark, text):
    return spark.createDataFrame([(text,)], "t string")


@pytest.mark.parametrize(
    ("text", "kind", "document"),
    [
        (None, "empty", "{}"), ("", "empty", "{}"), ('{"a":1}', "object", '{"a":1}'), ("[1]", "value", '{"value":[1]}'),
        ("nope", "raw", '{"raw":"nope"}'), ("null", "value", '{"value":null}'), ("[1] x", "raw", '{"raw":"[1] x"}'), ("1] [2", "raw", '{"raw":"1] [2"}'),
        ("1, 2", "raw", '{"raw":"1, 2"}'), ("1} x", "raw", '{"raw":"1} x"}'), (" 7 ", "value", '{"value":7}'), ("  ", "raw", '{"raw":"  "}'), ('"x"', "value", '{"value":"x"}'),
    ],
)
def test_details(spark, text, kind, document):
    row = documents.parse_details(one(spark, text), "t").first()
    assert (row["details_class"], row["details_json"]) == (kind, document)


@pytest.mark.parametrize(
    ("text", "payload"),
    [
        ('```json\n{"a": 1}\n```', '{"a":1}'), ('```JSON {"a": {"b": 2}} ```', '{"a":{"b":2}}'), ('So: {"a": 1} ok', '{"a":1}'),
        ("[1, 2]", None), ("{a}", None), ("}{", None), ("", None), (None, None), ('{"a": 1} and {"b": 2}', None),
    ],
)
def test_reply(spark, text, payload):
    assert documents.reply_object(one(spark, text), "t").select(F.to_json("payload")).first()[0] == payload


DEFINITIONS = [
    ('{"nodes":[{"id":"source"},{"id":"transform"}],"edges":[{"from":"source","to":"transform"}]}', None),
    ('{"nodes":[],"edges":[]}', fixed.NO_NODES),
    ('{"edges":[]}', fixed.NO_NODES),
    ('{"nodes":[{"id":1}]}', fixed.EDGES_NOT_LIST),
    ('{"nodes":[{"id":null}],"edges":[]}', fixed.NODE_WITHOUT_ID),
    ('{"nodes":["x"],"edges":[]}', None),
    ('{"nodes":["x"],"edges":[{"from":"x","to":"x"}]}', fixed.EDGE_UNKNOWN_NODE),
    ('{"nodes":[{"id":1}],"edges":[7]}', fixed.EDGE_NOT_OBJECT),
    ('{"nodes":[{"id":1}],"edges":[{"from":"1","to":1}]}', fixed.EDGE_UNKNOWN_NODE),
    ('{"nodes":[{"id":1}],"edges":[{"from":1,"to":1}]}', None),
    ("[]", fixed.NOT_AN_OBJECT),
]


@pytest.mark.parametrize(("text", "problem"), DEFINITIONS)
def test_definition(spark, text, problem):
    row = documents.validate_definitions(one(spark, text), "t").first()
    assert row["problem"] == problem
    assert (row["canonical_json"] is None) == (problem is not None)


def test_canonical_json_sorts_names(spark):
    text = '{"nodes":[{"z":1,"id":2}],"edges":[],"a":{"c":1,"b":2}}'
    row = documents.validate_definitions(one(spark, text), "t").first()
    assert row["canonical_json"] == '{"a":{"b":2,"c":1},"edges":[],"nodes":[{"id":2,"z":1}]}'


def plan(spark, reply):
    counts = spark.createDataFrame([(1, *[0] * 9)], "workspace_id bigint, " + ", ".join(f"{n} bigint" for n in fixed.SIGNALS))
    plans = rules.automation_plans(counts, "Goal").withColumn("model_confidence", F.lit(0.7)).withColumn("reply", F.lit(reply))
    return documents.normalise_plans(plans).first()


def test_model_plan(spark):
    row = plan(
        spark,
        '{"title":"T","summary":"S","automation_score":88,"triggers":["t"],"actions":[{"label":"L"}],"next_steps":["n"],"provider_notes":"p"}',
    )
    assert (row["title"], row["summary"], row["automation_score"], row["provider_notes"]) == ("T", "S", 88, "p")
    assert 0 <= row["confidence_score"] <= 1 and row["provider"] == "lm-studio"
    assert [tuple(a) for a in row["actions"]] == [("L", "L")] and [tuple(t) for t in row["triggers"]] == [("t", "t")]
    assert row["next_steps"] == ["n"]


def test_plan_without_reply_stays(spark):
    row = plan(spark, None)
    assert (row["title"], row["provider"], row["provider_notes"]) == ("Goal", "heuristic", fixed.HEURISTIC_NOTES)
    assert [t["name"] for t in row["triggers"]] == ["Dataset absence"]


def test_report_defaults(spark):
    row = documents.read_reports(one(spark, "{}"), "t").first()
    assert (row["row_count"], row["rejected_rows"], row["quality_score"]) == (0, 0, 0)
    assert row["columns"] == [] and row["issues"] == [] and row["metadata"] is None


def test_repeated_name_is_still_an_object(spark):
    df = spark.createDataFrame([('{"a":1,"a":2}',)], "details string")
    row = documents.parse_details(df).first()
    assert (row["details_class"], row["details_json"]) == ("object", '{"a":2}')
