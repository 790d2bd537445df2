"""Source, gate and sink queries. Written data goes to the shared scratch folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cells import normalise
from tidemark.operators import profile, sql
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import table
from tidemark.session import scratch_path
from tidemark.sources import admission, files, ingest, sinks

# --- scans ---------------------------------------------------------------------------------

# Quotes, commas, line breaks and blanks inside cells.
_AWKWARD = {
    "id": "c_custkey",
    "note": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE concat('say \"', c_name, '\", then', chr(10), 'stop ') END",
    "segment": "CASE WHEN c_custkey % 3 = 0 THEN '  ' ELSE c_mktsegment END",
    "nation": "c_nationkey",
}


def _as_csv(spark: SparkSession, sf_dir: str, columns: dict[str, str]) -> str:
    path = scratch_path(spark, "csv")
    table(spark, sf_dir, "customer").selectExpr(*[f"{e} AS {n}" for n, e in columns.items()]).write.option(
        "header", True
    ).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


@query(
    "scan_csv_raw",
    "SELECT " + ", ".join(f"trim(coalesce(CAST({e} AS VARCHAR), '')) AS {n}" for n, e in _AWKWARD.items()) + " FROM customer",
)
def scan_csv_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = files.scan_csv_raw(spark, _as_csv(spark, sf_dir, _AWKWARD))
    return raw.select([normalise(F.col(c)).alias(c) for c in raw.columns])


_TYPED = {
    "id": "c_custkey",
    "name": "c_name",
    "balance": "c_acctbal",
    "since": "DATE '2020-01-01' + CAST(c_nationkey AS INT)",
    "active": "c_nationkey > 10",
}


@query(
    "scan_csv_typed",
    "SELECT CAST(c_custkey AS INTEGER) AS id, c_name AS name, c_acctbal AS balance, "
    "strftime(DATE '2020-01-01' + CAST(c_nationkey AS INT), '%Y-%m-%d') AS since, 'date' AS since_type, c_nationkey > 10 AS active FROM customer",
)
def scan_csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = files.scan_csv_typed(spark, _as_csv(spark, sf_dir, _TYPED))
    return typed.withColumns({"since_type": F.typeof("since"), "since": F.col("since").cast("string")})


@query(
    "scan_parquet",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01' AND l_discount < 0.03",
)
def scan_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_shipdate", "l_discount"]
    lines = files.scan_parquet(spark, f"{sf_dir}/lineitem.parquet", columns)
    kept = lines.where((F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz")) & (F.col("l_discount") < 0.03))
    return kept.select("l_orderkey", "l_linenumber", "l_extendedprice")


# --- gate ----------------------------------------------------------------------------------

_UPLOAD = [
    "doc_id",
    "CASE WHEN doc_id % 2 = 0 THEN concat('in/', source, '.CSV') WHEN doc_id % 3 = 0 THEN NULL ELSE concat(source, '.txt') END AS file_name",
    "CASE WHEN doc_id % 5 = 0 THEN '  ' WHEN doc_id % 9 = 0 THEN concat(source, '.csv') ELSE source END AS dataset_name",
]


@query(
    "source_admission",
    f"WITH u AS (SELECT {', '.join(_UPLOAD)} FROM documents), n AS (SELECT *, regexp_extract(coalesce(nullif(file_name, ''), dataset_name), "
    "'([^/]+)$', 1) AS source_name FROM u), r AS (SELECT *, CASE WHEN trim(dataset_name) = '' THEN 'Dataset name is required' "
    "WHEN lower(source_name) NOT LIKE '%.csv' THEN 'Only CSV uploads are supported in the MVP' END AS rejection FROM n) "
    "SELECT doc_id, source_name, rejection IS NULL AS accepted, coalesce(rejection, '') AS rejection FROM r",
)
def source_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = table(spark, sf_dir, "documents").selectExpr(*_UPLOAD)
    return admission.source_admission(uploads).select(
        "doc_id", "source_name", "accepted", F.coalesce("rejection", F.lit("")).alias("rejection")
    )


_NAME = (
    "CASE WHEN doc_id % 4 = 0 THEN concat(source, '.csv') WHEN doc_id % 4 = 1 THEN concat(source, '.tsv') "
    "WHEN doc_id % 4 = 2 THEN concat('http://', source) ELSE concat(source, '.CSV') END"
)


@query(
    "infer_source_type",
    f"WITH s AS (SELECT {_NAME} AS name FROM documents UNION ALL SELECT url FROM pages) SELECT name, "
    "CASE WHEN name LIKE '%.csv' OR name LIKE '%.tsv' THEN 'file' WHEN name LIKE 'http%' THEN 'api' ELSE 'database' END AS source_type, "
    "COUNT(*) AS n FROM s GROUP BY name",
)
def infer_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "documents").selectExpr(f"{_NAME} AS name").unionByName(
        table(spark, sf_dir, "pages").selectExpr("url AS name")
    )
    return names.select("name", admission.infer_source_type(F.col("name")).alias("source_type")).groupBy(
        "name", "source_type"
    ).agg(F.count(F.lit(1)).alias("n"))


_PATH = "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE concat('raw/', source, '.csv') END"


@query(
    "resolve_dataset",
    f"WITH reg AS (SELECT doc_id, {_PATH} AS p FROM documents), present AS (SELECT DISTINCT concat('raw/', source, '.csv') AS p "
    "FROM documents WHERE lang = 'es' AND n_chars > 3000), w AS (SELECT l_partkey AS id, COUNT(*) AS requests FROM lineitem GROUP BY l_partkey) "
    "SELECT w.id AS dataset_id, requests, CASE WHEN reg.doc_id IS NULL THEN 'unknown' WHEN reg.p IS NULL THEN 'no_path' "
    "WHEN present.p IS NULL THEN 'missing_file' ELSE 'resolved' END AS outcome "
    "FROM w LEFT JOIN reg ON reg.doc_id = w.id LEFT JOIN present ON present.p = reg.p",
)
def resolve_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    known = documents.selectExpr("doc_id AS dataset_id", f"{_PATH} AS storage_path")
    present = documents.where("lang = 'es' AND n_chars > 3000").selectExpr("concat('raw/', source, '.csv') AS storage_path")
    wanted = table(spark, sf_dir, "lineitem").selectExpr("l_partkey AS dataset_id")
    return admission.resolve_datasets(wanted, known, present).select("dataset_id", "requests", "outcome")


@query("preview_rows", "SELECT * FROM customer ORDER BY c_custkey LIMIT 5")
def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql.preview(table(spark, sf_dir, "customer"), "c_custkey")


# --- sinks ---------------------------------------------------------------------------------


@query(
    "land_raw",
    "SELECT l_returnflag AS workspace, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) + CASE WHEN l_returnflag = 'R' THEN COUNT(*) ELSE 0 END AS lines "
    "FROM lineitem GROUP BY l_returnflag",
)
def land_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the table by workspace, then replace one workspace; the others stay."""
    path = scratch_path(spark, "landed")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_returnflag", "workspace")
    sinks.land_raw(lines, path, ["workspace"])
    again = lines.where("workspace = 'R'").withColumn("l_linenumber", F.col("l_linenumber") + 1)
    sinks.land_raw(again, path, ["workspace"])
    return (
        spark.read.parquet(path)
        .groupBy("workspace")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_linenumber").cast("bigint")).alias("lines"))
    )


@query(
    "write_ingest_outcome",
    "SELECT 1::BIGINT AS workspace_id, 5::BIGINT AS dataset_id, 'part.csv' AS source_name, 'file' AS source_type, 'completed' AS status, "
    "COUNT(*) AS row_count, 0::BIGINT AS rejected_rows, 100::INTEGER AS quality_score FROM part",
)
def write_ingest_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "registry")
    summary = profile.profile_table(table(spark, sf_dir, "part"))
    outcome = sinks.ingest_outcome(
        summary, workspace_id=1, dataset_id=5, name="parts", source_name="part.csv", storage_path="raw/part.csv"
    )
    sinks.write_ingest_outcome(outcome, root, "upload=1-5")
    return spark.read.parquet(f"{root}/ingestion_jobs").select(
        "workspace_id", "dataset_id", "source_name", "source_type", "status", "row_count", "rejected_rows", "quality_score"
    )


@query(
    "ingest_upload",
    "SELECT j.*, e.event_type FROM (SELECT 3::BIGINT AS workspace_id, 9::BIGINT AS dataset_id, 'customers.csv' AS source_name, COUNT(*) AS row_count, "
    "0::BIGINT AS rejected_rows, CAST(100 - CAST(trunc((COUNT(*) FILTER (WHERE c_custkey % 5 = 0) + COUNT(*) FILTER (WHERE c_custkey % 3 = 0)) "
    "/ (COUNT(*) * 4) * 50.0) AS INTEGER) AS INTEGER) AS quality_score, 'customers.csv' AS reported_source, 4 AS reported_columns, "
    "COUNT(*) AS reported_rows, TRUE AS has_version FROM customer) j, "
    "(SELECT unnest(['dataset.uploaded', 'metadata.ingestion.profile_created']) AS event_type) e",
)
def ingest_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV through gate, landing, profile, registry and event log, twice; job and stored report beside the events."""
    root, path = scratch_path(spark, "ingest"), _as_csv(spark, sf_dir, _AWKWARD)
    for _ in range(2):
        ingest.ingest_csv(
            spark, path, root, workspace_id=3, dataset_id=9, dataset_name="customers", file_name="up/customers.csv"
        )
    jobs = spark.read.parquet(f"{root}/ingestion_jobs").select(
        "workspace_id", "dataset_id", "source_name", "row_count", "rejected_rows", "quality_score"
    )
    stored = F.from_json(
        "summary_json", "row_count bigint, metadata struct<profile_version:string,source_name:string,column_count:int>"
    )
    reports = spark.read.parquet(f"{root}/data_quality_reports").select("dataset_id", stored.alias("s")).select(
        "dataset_id",
        F.col("s.metadata.source_name").alias("reported_source"),
        F.col("s.metadata.column_count").alias("reported_columns"),
        F.col("s.row_count").alias("reported_rows"),
        F.col("s.metadata.profile_version").isNotNull().alias("has_version"),
    )
    events = spark.read.parquet(f"{root}/events").select("event_type", F.col("resource_id").alias("dataset_id"))
    return jobs.join(reports, "dataset_id").join(events, "dataset_id")


@query(
    "emit_events",
    "SELECT o_custkey AS workspace_id, 'dataset.query_executed' AS event_type, o_orderkey AS resource_id, "
    "concat('{\"priority\":\"', o_orderpriority, '\",\"status\":\"', o_orderstatus, '\"}') AS details FROM orders",
)
def emit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events")
    rows = sinks.event_rows(
        table(spark, sf_dir, "orders"),
        event_type=F.lit("dataset.query_executed"),
        workspace_id=F.col("o_custkey"),
        resource_type=F.lit("dataset"),
        resource_id=F.col("o_orderkey"),
        details={"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")},
        actor=F.lit("system"),
    )
    sinks.emit_events(rows, path)
    return spark.read.parquet(path).select("workspace_id", "event_type", "resource_id", "details")
