"""Profiling and statistics queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.cells import normalise_row, to_double, to_long
from tidemark.operators import profile, states, stats
from tidemark.plans.catalog import query
from tidemark.plans.stand_ins import DIRTY_COLUMNS, dirty_parts, dirty_sql, inferred_sql, table
from tidemark.session import scratch_path

NAMES = list(DIRTY_COLUMNS)
CELLS = dirty_sql()
ROW = ", ".join(NAMES)
BLANK = " AND ".join(f"{n} = ''" for n in NAMES)
MISSING = " + ".join(f"COUNT(*) FILTER (WHERE {n} = '')" for n in NAMES)
TOTALS = (
    f"totals AS (SELECT COUNT(*) AS n, {MISSING} AS gaps, COUNT(*) FILTER (WHERE {BLANK}) AS blank, "
    f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT {ROW} FROM cells)) AS dup FROM cells)"
)
SCORE = (
    f"CAST(greatest(0, least(100, 100 - CAST(trunc(gaps / greatest(n * {len(NAMES)}, 1) * 50.0 "
    "+ dup / greatest(n, 1) * 25.0 + blank / greatest(n, 1) * 25.0) AS INTEGER))) AS INTEGER)"
)
ISSUES = (
    "concat_ws('; ', CASE WHEN gaps > 0 THEN concat(gaps, ' missing values detected') END, "
    "CASE WHEN dup > 0 THEN concat(dup, ' duplicate rows detected') END, "
    "CASE WHEN blank > 0 THEN concat(blank, ' fully blank rows detected') END)"
)


@query("normalise_cells", f"WITH {dirty_sql('p_partkey')} SELECT * FROM cells")
def normalise_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dirty_parts(spark, sf_dir, "p_partkey")
    return raw.select("p_partkey", *[c for c, n in zip(normalise_row(raw.schema), raw.columns) if n != "p_partkey"])


@query("profile_row_count", f"WITH {CELLS} SELECT COUNT(*) AS row_count FROM cells")
def profile_row_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dirty_parts(spark, sf_dir).agg(F.count(F.lit(1)).alias("row_count"))


def _per_column(value: str, name: str) -> str:
    parts = [f"SELECT '{n}' AS name, {value.format(n=n)} AS {name} FROM cells" for n in NAMES]
    return f"WITH {CELLS} " + " UNION ALL ".join(parts)


@query("profile_missing", _per_column("COUNT(*) FILTER (WHERE {n} = '')", "missing"))
def profile_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(dirty_parts(spark, sf_dir)).select("name", "missing")


@query("profile_sample_size", _per_column("COUNT(*) FILTER (WHERE {n} <> '')", "sample_size"))
def profile_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(dirty_parts(spark, sf_dir)).select("name", "sample_size")


@query(
    "profile_inferred_type",
    f"WITH {CELLS} " + " UNION ALL ".join(f"SELECT '{n}' AS name, {inferred_sql(n)} AS inferred_type FROM cells" for n in NAMES),
)
def profile_inferred_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_columns(dirty_parts(spark, sf_dir)).select("name", "inferred_type")


@query("profile_blank_rows", f"WITH {CELLS}, {TOTALS} SELECT blank AS rejected_rows FROM totals")
def profile_blank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_totals(dirty_parts(spark, sf_dir)).select(F.col("blank_rows").alias("rejected_rows"))


@query("profile_duplicate_rows", f"WITH {CELLS}, {TOTALS} SELECT dup AS duplicate_rows FROM totals")
def profile_duplicate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.row_totals(dirty_parts(spark, sf_dir)).select(
        (F.col("row_count") - F.col("distinct_rows")).alias("duplicate_rows")
    )


@query("profile_quality_score", f"WITH {CELLS}, {TOTALS} SELECT {SCORE} AS quality_score FROM totals")
def profile_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(dirty_parts(spark, sf_dir)).select("quality_score")


@query("profile_issues", f"WITH {CELLS}, {TOTALS} SELECT {ISSUES} AS issues FROM totals")
def profile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(dirty_parts(spark, sf_dir)).select(F.array_join("issues", "; ").alias("issues"))


@query("distinct_rows", f"WITH {CELLS} SELECT DISTINCT {ROW} FROM cells")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.distinct_rows(dirty_parts(spark, sf_dir))


def _typed_profile_check(name: str, columns: dict[str, str]) -> str:
    """Profile of a typed table in long form; ``columns`` maps name to inferred type."""
    totals = (
        f"t AS (SELECT COUNT(*) AS n, {' + '.join(f'COUNT(*) FILTER (WHERE {c} IS NULL)' for c in columns)} AS missing, "
        f"COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM {name})) AS dup FROM {name})"
    )
    score = (
        f"CAST(100 - CAST(trunc(missing / (n * {len(columns)}) * 50.0 + dup / n * 25.0) AS INTEGER) AS INTEGER)"
    )
    parts = [
        f"SELECT n AS row_count, 0::BIGINT AS rejected_rows, {score} AS quality_score, dup AS duplicate_rows, "
        f"'{c}' AS name, (SELECT COUNT(*) FILTER (WHERE {c} IS NULL) FROM {name}) AS missing, "
        f"(SELECT COUNT({c}) FROM {name}) AS sample_size, '{kind}' AS inferred_type FROM t"
        for c, kind in columns.items()
    ]
    return f"WITH {totals} " + " UNION ALL ".join(parts)


LINEITEM = {
    "l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer",
    "l_quantity": "number", "l_extendedprice": "number", "l_discount": "number", "l_tax": "number",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "string",
}


@query("profile_table", _typed_profile_check("lineitem", LINEITEM))
def profile_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(table(spark, sf_dir, "lineitem")).select(
        "row_count", "rejected_rows", "quality_score", "duplicate_rows", F.inline("columns")
    )


@query(
    "profile_table_text",
    f"WITH {CELLS}, {TOTALS}, kinds AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, COUNT(*) FILTER (WHERE {n} = '') AS missing, COUNT(*) FILTER (WHERE {n} <> '') AS sample_size, "
        f"{inferred_sql(n)} AS inferred_type FROM cells"
        for n in NAMES
    )
    + f") SELECT n AS row_count, blank AS rejected_rows, {SCORE} AS quality_score, {ISSUES} AS issues, kinds.* FROM totals, kinds",
)
def profile_table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_table(dirty_parts(spark, sf_dir)).select(
        "row_count", "rejected_rows", "quality_score", F.array_join("issues", "; ").alias("issues"), F.inline("columns")
    )


_SCHEMA_JSON = "concat('[', string_agg(concat('{\"inferred_type\":\"', inferred_type, '\",\"name\":\"', name, '\"}'), ',' ORDER BY i), ']')"
_KINDS = "kinds AS (" + " UNION ALL ".join(
    f"SELECT {i} AS i, '{n}' AS name, COUNT(*) FILTER (WHERE {n} = '') AS missing, COUNT(*) FILTER (WHERE {n} <> '') AS sample_size, "
    f"{inferred_sql(n)} AS inferred_type FROM cells"
    for i, n in enumerate(NAMES)
) + ")"
_ISSUES_JSON = f"concat('[\"', replace({ISSUES}, '; ', '\",\"'), '\"]')"


@query(
    "profile_fingerprint",
    f"WITH {CELLS}, {TOTALS}, {_KINDS} SELECT sha256(concat('{{\"issues\":', {_ISSUES_JSON}, ',\"quality_score\":', {SCORE}, "
    f"',\"rejected_rows\":', blank, ',\"row_count\":', n, ',\"schema\":', (SELECT {_SCHEMA_JSON} FROM kinds), '}}')) "
    "AS profile_fingerprint FROM totals",
)
def profile_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_fingerprint(profile.profile_table(dirty_parts(spark, sf_dir))).select("profile_fingerprint")


_COLUMN_JSON = (
    "concat('[', string_agg(concat('{\"inferred_type\":\"', inferred_type, '\",\"missing\":', missing, ',\"name\":\"', name, "
    "'\",\"sample_size\":', sample_size, '}'), ',' ORDER BY i), ']')"
)


@query(
    "profile_report_json",
    f"WITH {CELLS}, {TOTALS}, {_KINDS} SELECT concat('{{\"columns\":', (SELECT {_COLUMN_JSON} FROM kinds), ',\"issues\":', {_ISSUES_JSON}, "
    f"',\"quality_score\":', {SCORE}, ',\"rejected_rows\":', blank, ',\"row_count\":', n, '}}') AS summary_json FROM totals",
)
def profile_report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.profile_json(profile.profile_table(dirty_parts(spark, sf_dir))).select("summary_json")


@query(
    "fingerprint_changes",
    "WITH h AS (SELECT user_id AS dataset_id, event_id AS report_id, sha256(event_type) AS f, ts FROM events) "
    "SELECT dataset_id, report_id, coalesce(lag(f) OVER (PARTITION BY dataset_id ORDER BY ts, report_id) <> f, TRUE) AS changed FROM h",
)
def fingerprint_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("dataset_id"),
        F.col("event_id").alias("report_id"),
        F.col("ts").alias("created_at"),
        F.sha2("event_type", 256).alias("profile_fingerprint"),
    )
    return profile.fingerprint_changes(history, F.date_trunc("day", "created_at")).select(
        "dataset_id", "report_id", "changed"
    )


@query(
    "cast_inferred",
    f"WITH {CELLS} SELECT DISTINCT nullif(name, '') AS name, nullif(brand, '') AS brand, "
    "TRY_CAST(nullif(replace(size_text, '_', ''), '') AS BIGINT) AS size_text, "
    "TRY_CAST(nullif(price_text, '') AS DOUBLE) AS price_text, nullif(mixed_text, '') AS mixed_text "
    f"FROM cells WHERE NOT ({BLANK})",
)
def cast_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = dirty_parts(spark, sf_dir)
    return profile.cast_inferred(raw, profile.castable_types(raw))


@query(
    "number_tests",
    f"WITH {dirty_sql('p_partkey')} SELECT p_partkey, regexp_full_match(size_text, '[+-]?[0-9]+(_[0-9]+)*') AS size_is_integer, "
    "coalesce(TRY_CAST(nullif(replace(size_text, '_', ''), '') AS BIGINT), -1) AS size_long, "
    "CASE WHEN mixed_text <> '' AND NOT contains(mixed_text, 'd') THEN CAST(mixed_text AS DOUBLE) END AS mixed_double FROM cells",
)
def number_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.functions.cells import is_integer, normalise

    size, mixed = normalise(F.col("size_text")), normalise(F.col("mixed_text"))
    return dirty_parts(spark, sf_dir, "p_partkey").select(
        "p_partkey",
        is_integer(size).alias("size_is_integer"),
        F.coalesce(to_long(size), F.lit(-1)).alias("size_long"),
        to_double(mixed).alias("mixed_double"),
    )


# --- statistics ----------------------------------------------------------------------------

_ORDERS = {
    "o_orderkey": "number", "o_custkey": "number", "o_orderstatus": "string", "o_totalprice": "number",
    "o_orderdate": "datetime", "o_orderpriority": "string",
}


def _stats_check(name: str, columns: dict[str, str], what: str) -> str:
    parts = []
    for i, (c, kind) in enumerate(columns.items()):
        text = f"strftime({c}, '%Y-%m-%d %H:%M:%S')" if kind == "datetime" else c
        low, high, mean = (
            (f"CAST(MIN({c}) AS DOUBLE)", f"CAST(MAX({c}) AS DOUBLE)", f"ROUND(AVG({c}), 4)")
            if kind == "number"
            else ("CAST(NULL AS DOUBLE)",) * 3
        )
        first, last = ("CAST(NULL AS VARCHAR)",) * 2 if kind == "number" else (f"MIN({text})", f"MAX({text})")
        parts.append(
            f"SELECT {i} AS position, '{c}' AS name, '{kind}' AS data_type, COUNT(*) AS row_count, COUNT({c}) AS non_null_count, "
            f"COUNT(*) - COUNT({c}) AS null_count, COUNT(DISTINCT {c}) AS distinct_count, {low} AS min_num, {high} AS max_num, "
            f"{mean} AS mean_num, {first} AS min_str, {last} AS max_str FROM {name}"
        )
    return f"SELECT {what} FROM (" + " UNION ALL ".join(parts) + ") s"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean_num", F.round("mean_num", 4)).drop("min_exact", "max_exact")


@query("dataset_statistics", _stats_check("orders", _ORDERS, "*"))
def dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.column_statistics(table(spark, sf_dir, "orders")))


_LINES = {
    "l_orderkey": "number", "l_partkey": "number", "l_suppkey": "number", "l_linenumber": "number", "l_quantity": "number",
    "l_extendedprice": "number", "l_discount": "number", "l_tax": "number", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "datetime",
}


@query("dataset_statistics_lineitem", _stats_check("lineitem", _LINES, "*"))
def dataset_statistics_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.column_statistics(table(spark, sf_dir, "lineitem")))


@query("column_counts", _stats_check("orders", _ORDERS, "name, non_null_count, null_count, distinct_count"))
def column_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.column_statistics(table(spark, sf_dir, "orders")).select(
        "name", "non_null_count", "null_count", "distinct_count"
    )


@query(
    "column_numeric_range",
    _stats_check("orders", _ORDERS, "name, min_num, max_num, mean_num") + " WHERE data_type = 'number'",
)
def column_numeric_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _rounded(stats.column_statistics(table(spark, sf_dir, "orders"))).where("data_type = 'number'")
    return wide.select("name", "min_num", "max_num", "mean_num")


@query(
    "column_string_range",
    _stats_check("orders", _ORDERS, "name, min_str, max_str") + " WHERE data_type <> 'number'",
)
def column_string_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = stats.column_statistics(table(spark, sf_dir, "orders")).where("data_type <> 'number'")
    return wide.select("name", "min_str", "max_str")


_TEXT_KINDS = {"name": 0, "brand": 0, "size_text": 1, "price_text": 1, "mixed_text": 0}


@query(
    "dataset_statistics_text",
    f"WITH {CELLS} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS name, '{'number' if numeric else 'string'}' AS data_type, COUNT(*) AS row_count, "
        f"COUNT(*) FILTER (WHERE {n} <> '') AS non_null_count, COUNT(*) FILTER (WHERE {n} = '') AS null_count, "
        f"COUNT(DISTINCT nullif({n}, '')) AS distinct_count, "
        + (
            f"MIN(TRY_CAST(nullif(replace({n}, '_', ''), '') AS DOUBLE)) AS min_num, "
            f"MAX(TRY_CAST(nullif(replace({n}, '_', ''), '') AS DOUBLE)) AS max_num, "
            f"ROUND(AVG(TRY_CAST(nullif(replace({n}, '_', ''), '') AS DOUBLE)), 4) AS mean_num, "
            "CAST(NULL AS VARCHAR) AS min_str, CAST(NULL AS VARCHAR) AS max_str "
            if numeric
            else "CAST(NULL AS DOUBLE) AS min_num, CAST(NULL AS DOUBLE) AS max_num, CAST(NULL AS DOUBLE) AS mean_num, "
            f"MIN(nullif({n}, '')) AS min_str, MAX(nullif({n}, '')) AS max_str "
        )
        + "FROM cells"
        for n, numeric in _TEXT_KINDS.items()
    ),
)
def dataset_statistics_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(stats.column_statistics(dirty_parts(spark, sf_dir))).drop("position")


def _appended_lines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """lineitem, and the figures and keys of three appends that make it up: by ship date, and rows without one."""
    lines, path = table(spark, sf_dir, "lineitem"), scratch_path(spark, "states")
    early = F.col("l_shipdate") < "1995-06-17"
    for version, part in enumerate((early, ~early, early.isNull())):
        states.append_state(lines.where(part), path, version)
    return lines, *states.read_states(spark, path)


@query("merged_statistics", _stats_check("lineitem", _LINES, "*"))
def merged_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, figures, keys = _appended_lines(spark, sf_dir)
    return _rounded(states.merged_statistics(figures, keys, lines.schema))


@query("merged_profile", _typed_profile_check("lineitem", LINEITEM))
def merged_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, figures, keys = _appended_lines(spark, sf_dir)
    return states.merged_profile(figures, keys, lines.columns).select(
        "row_count", "rejected_rows", "quality_score", "duplicate_rows", F.inline("columns")
    )


_LINE_COLUMNS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
]


@query(
    "approximate_statistics",
    " UNION ALL ".join(
        f"SELECT '{c}' AS name, COUNT({c}) AS non_null_count, COUNT(DISTINCT {c}) AS distinct_count, TRUE AS within_bound FROM lineitem"
        for c in _LINE_COLUMNS
    ),
)
def approximate_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The approximate counts lie within three standard errors of the exact ones."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINE_COLUMNS)
    exact = stats.column_statistics(lines).select("name", "distinct_count")
    near = F.abs(F.col("approx_distinct") - F.col("distinct_count")) <= 3 * 0.02 * F.col("distinct_count")
    return stats.approximate_statistics(lines, 0.02).join(exact, "name").select(
        "name", "non_null_count", "distinct_count", near.alias("within_bound")
    )


@query(
    "metric_insight",
    "SELECT event_type AS title, concat(event_type, ' is currently ', printf('%.2f', ROUND(AVG(value), 2)), '.') AS summary, "
    "0.8::DOUBLE AS confidence FROM events GROUP BY event_type",
)
def metric_insight(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("name"))
        .agg(F.round(F.avg("value"), 2).alias("value"))
    )
    return stats.metric_insights(metrics)
