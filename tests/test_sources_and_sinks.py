"""Gate, landing, registry rows, events, masks and access."""

import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance, profile
from tidemark.session import scratch_path, shared_dir
from tidemark.sources import admission, sinks
from tidemark.sources.ingest import ingest_csv
from tidemark.sources.files import scan_csv_raw


def test_gate(spark):
    rows = [(1, "a/b/x.csv", "n"), (2, "x.txt", "n"), (3, "x.csv", " \t"), (4, None, "y.CSV"), (5, "", "y")]
    got = admission.source_admission(spark.createDataFrame(rows, "id int, file_name string, dataset_name string")).collect()
    assert {r["id"]: (r["source_name"], r["rejection"]) for r in got} == {
        1: ("x.csv", None), 2: ("x.txt", "Only CSV uploads are supported in the MVP"), 3: ("x.csv", "Dataset name is required"),
        4: ("y.CSV", None), 5: ("y", "Only CSV uploads are supported in the MVP"),
    }


def test_source_types(spark):
    names = {"a.csv": "file", "a.tsv": "file", "http://x": "api", "a.CSV": "database", "http://x/a.csv": "file"}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r[0]: r[1] for r in df.select("n", admission.infer_source_type(F.col("n"))).collect()} == names


def test_resolve(spark):
    requests = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "dataset_id int")
    known = spark.createDataFrame([(1, "p1"), (2, None), (3, "p3")], "dataset_id int, storage_path string")
    files = spark.createDataFrame([("p1",)], "storage_path string")
    got = admission.resolve_datasets(requests, known, files).collect()
    assert {r["dataset_id"]: (r["outcome"], r["requests"]) for r in got} == {
        1: ("resolved", 2), 2: ("no_path", 1), 3: ("missing_file", 1), 4: ("unknown", 1)
    }


def test_landing_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "landed")
    sinks.land_raw(spark.createDataFrame([(1, "a"), (2, "b")], "ws int, v string"), path, ["ws"])
    sinks.land_raw(spark.createDataFrame([(2, "c")], "ws int, v string"), path, ["ws"])
    assert sorted((r["ws"], r["v"]) for r in spark.read.parquet(path).collect()) == [(1, "a"), (2, "c")]


def test_ingest_outcome(spark, write, tmp_path):
    path = write("id,amount\n1,10\n2,20\n")
    summary = profile.profile_metadata(profile.profile_table(scan_csv_raw(spark, path)), "sales.csv", path)
    assert summary.first()["metadata"]["profile_version"] == "1.1" and summary.first()["metadata"]["column_count"] == 2
    tables = sinks.ingest_outcome(summary, workspace_id=1, dataset_id=2, name="sales", source_name="sales.csv", storage_path=path)
    sinks.write_ingest_outcome(tables, str(tmp_path / "reg"), "upload=1-2")
    job = spark.read.parquet(str(tmp_path / "reg" / "ingestion_jobs")).first()
    assert (job["row_count"], job["rejected_rows"], job["quality_score"], job["status"]) == (2, 0, 100, "completed")
    report = spark.read.parquet(str(tmp_path / "reg" / "data_quality_reports")).first()
    text = json.loads(report["summary_json"])
    assert list(text) == sorted(text) and text["columns"][0] == {
        "inferred_type": "integer", "missing": 0, "name": "id", "sample_size": 2
    }
    event = sinks.profile_event(summary, workspace_id=1, dataset_id=2, report_id=3, dataset_name="sales").first()
    assert event["event_type"] == "metadata.ingestion.profile_created"
    assert json.loads(event["details"]) == {
        "dataset_name": "sales", "quality_score": 100, "rejected_rows": 0, "report_id": 3, "row_count": 2
    }


def test_upload_path(spark, write, tmp_path):
    root = str(tmp_path / "lake")
    path = write("workspace_id,amount\n7,10\n8,20\n", "sales.csv")
    got = ingest_csv(spark, path, root, workspace_id=1, dataset_id=2, dataset_name="sales").first()
    assert (got["row_count"], got["quality_score"]) == (2, 100)
    assert got["metadata"]["source_name"] == "sales.csv"
    landed = spark.read.parquet(got["metadata"]["storage_path"])
    assert sorted(tuple(r) for r in landed.collect()) == [("7", "10"), ("8", "20")]
    events = spark.read.parquet(f"{root}/events").where("workspace_id = 1 AND event_type LIKE 'metadata.%' AND resource_id = 2")
    assert events.count() == 1 and json.loads(events.first()["details"])["row_count"] == 2
    types = {r["event_type"] for r in spark.read.parquet(f"{root}/events").collect()}
    assert types == {"dataset.uploaded", "metadata.ingestion.profile_created"}
    report = json.loads(spark.read.parquet(f"{root}/data_quality_reports").first()["summary_json"])
    assert report["metadata"]["source_name"] == "sales.csv" and report["metadata"]["column_count"] == 2
    ingest_csv(spark, path, root, workspace_id=1, dataset_id=2, dataset_name="sales")
    counts = {n: spark.read.parquet(f"{root}/{n}").count() for n in ("datasets", "data_quality_reports", "ingestion_jobs", "events")}
    assert counts == {"datasets": 1, "data_quality_reports": 1, "ingestion_jobs": 1, "events": 2}
    with pytest.raises(ValueError, match="more than once"):
        ingest_csv(spark, write("a,a\n1,2\n", "twice.csv"), root, workspace_id=1, dataset_id=4, dataset_name="twice")
    ids = dict(workspace_id=1, dataset_id=3)
    with pytest.raises(ValueError, match="Only CSV uploads"):
        ingest_csv(spark, write("a\n1\n", "a.txt"), root, dataset_name="a", **ids)
    with pytest.raises(ValueError, match="Dataset name is required"):
        ingest_csv(spark, path, root, dataset_name=" ", **ids)


def test_masks(spark):
    df = spark.createDataFrame([("ann@x.org", "12345", "s", "t"), (None, None, None, None)], "email string, card string, h string, gone string")
    rules = {"email": "redact", "card": "partial", "h": "hash", "gone": "null"}
    first, second = governance.apply_masks(df, rules).collect()
    assert (first["email"], first["card"], first["gone"]) == ("***", "***2345", None) and len(first["h"]) == 64
    assert tuple(second) == (None, None, None, None)
    with pytest.raises(ValueError, match="Unknown mask type"):
        governance.apply_masks(df, {"email": "blur"})
    with pytest.raises(ValueError, match="not in the table"):
        governance.apply_masks(df, {"nope": "redact"})


def test_short_values_stay_hidden(spark):
    df = spark.createDataFrame([("abcd",), ("abcde",)], "v string")
    assert [r["v"] for r in governance.apply_masks(df, {"v": "partial"}).collect()] == ["***", "***bcde"]


def test_newest_mask_rule_wins(spark):
    masks = spark.createDataFrame(
        [(1, 7, "email", "hash"), (2, 7, "email", "redact"), (3, 8, "email", "null")],
        "id int, dataset_id int, column_name string, mask_type string",
    )
    assert governance.mask_rules(masks, 7) == {"email": "redact"}


def test_access(spark):
    members = spark.createDataFrame([(1, "o", "owner"), (1, "a", "analyst")], "workspace_id int, user string, role string")
    tries = spark.createDataFrame([(1, 1, "o"), (2, 1, "a"), (3, 2, "o")], "attempt_id int, workspace_id int, user string")
    got = governance.access_review(tries, members, ["owner", "admin"]).collect()
    assert {r["attempt_id"]: (r["allowed"], r["reason"]) for r in got} == {
        1: (True, None), 2: (False, "Insufficient workspace role: analyst"), 3: (False, "No workspace membership found for user")
    }


def test_scratch_lies_in_the_configured_folder(spark):
    assert spark.conf.get("spark.checkpoint.dir", None) in (None, shared_dir(spark))
    assert scratch_path(spark, "x").startswith(shared_dir(spark) + "/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
