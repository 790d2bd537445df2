"""Ad-hoc SQL over a view named ``dataset``."""

from __future__ import annotations

import re
import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed_values as fixed

QUOTED_NAMES = "spark.sql.ansi.doubleQuotedIdentifiers"

_analysis = threading.Lock()


@contextmanager
def _quoted_names(spark: SparkSession):
    before = spark.conf.get(QUOTED_NAMES, "false")
    spark.conf.set(QUOTED_NAMES, "true")
    try:
        yield
    finally:
        spark.conf.set(QUOTED_NAMES, before)


def run_sql(sql: str, dataset: DataFrame, **views: DataFrame) -> DataFrame:
    """The query's result as a DataFrame, not yet run.

    ``dataset`` and any further views exist only while the text is analysed; views that the
    session had under these names come back. ``"name"`` means a column, as in standard SQL. Only queries
    are accepted: the text is first analysed as a subquery, which a command cannot be.
    """
    spark = dataset.sparkSession
    text = re.sub(r"(\s|;[ \t]*--[^\n]*|\n[ \t]*--[^\n]*|;)+\Z", "", sql)
    with _analysis, _quoted_names(spark):
        own = {"dataset": dataset, **views}
        held = {n: spark.table(n) for n in own if any(t.isTemporary for t in spark.catalog.listTables(pattern=n))}
        for name, df in own.items():
            df.createOrReplaceTempView(name)
        try:
            spark.sql(f"SELECT * FROM (\n{text}\n)")
            return spark.sql(sql)
        finally:
            for name in own:
                spark.catalog.dropTempView(name)
            for name, df in held.items():
                df.createOrReplaceTempView(name)


def capped(df: DataFrame, max_rows: int = fixed.ROW_CAP) -> DataFrame:
    """At most ``max_rows`` rows; the limit is part of the plan, so no more are computed."""
    return df.limit(max_rows)


def query_dataset(
    sql: str,
    dataset: DataFrame,
    max_rows: int = fixed.ROW_CAP,
    timeout_seconds: float = fixed.QUERY_SECONDS,
    **views: DataFrame,
) -> tuple[list[str], list[dict]]:
    """Column names and at most ``max_rows`` rows; the job is cancelled after the time limit."""
    spark = dataset.sparkSession
    result = capped(run_sql(sql, dataset, **views), max_rows)
    context, tag = spark.sparkContext, f"query-{uuid.uuid4().hex}"
    expired = threading.Event()

    def interrupt() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout_seconds, interrupt)
    context.addJobTag(tag)
    timer.start()
    try:
        return result.columns, [row.asDict() for row in result.collect()]
    except Exception as error:
        if expired.is_set():
            raise TimeoutError("Query timed out") from error
        raise
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def suggested_sql(dataset_name: str, columns: list[str]) -> str:
    """Starter query text for a dataset's first columns."""
    title = dataset_name.strip() or "uploaded dataset"
    if not columns:
        return f"-- {title}\nSELECT *\nFROM dataset\nLIMIT {fixed.SUGGESTED_LIMIT};"
    chosen = ", ".join(f'"{c}"' for c in columns[: fixed.SUGGESTED_COLUMNS])
    return f"-- {title}\nSELECT {chosen}\nFROM dataset\nORDER BY 1 DESC\nLIMIT {fixed.SUGGESTED_LIMIT};"


def preview(df: DataFrame, *order: str, rows: int = fixed.PREVIEW_ROWS) -> DataFrame:
    """The first rows in key order."""
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(rows)
