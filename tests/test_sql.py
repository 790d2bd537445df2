"""Ad-hoc SQL over ``dataset``."""

import pytest

from tidemark.operators import sql
from tidemark.sources.files import scan_csv_typed


@pytest.fixture
def sales(spark, write):
    return scan_csv_typed(spark, write("id,amount\n1,10\n2,20\n"))


def test_query_returns_names_and_rows(sales):
    columns, rows = sql.query_dataset("SELECT id, amount FROM dataset ORDER BY id", sales, timeout_seconds=60)
    assert columns == ["id", "amount"]
    assert rows == [{"id": 1, "amount": 10}, {"id": 2, "amount": 20}]


def test_double_quotes_name_columns_and_the_setting_is_put_back(spark, sales):
    before = spark.conf.get(sql.QUOTED_NAMES, "false")
    assert [r[0] for r in sql.run_sql('SELECT "amount" FROM dataset ORDER BY "id"', sales).collect()] == [10, 20]
    with pytest.raises(Exception):
        sql.run_sql("SELECT nothing FROM dataset", sales)
    assert spark.conf.get(sql.QUOTED_NAMES, "false") == before
    assert not spark.catalog.tableExists("dataset")


def test_comments_and_semicolon(sales):
    assert sql.run_sql(sql.suggested_sql("sales", sales.columns), sales).first()["id"] == 2


def test_suggested_text():
    assert sql.suggested_sql(" ", []) == "-- uploaded dataset\nSELECT *\nFROM dataset\nLIMIT 25;"
    text = sql.suggested_sql("x", list("abcdefg"))
    assert text == '-- x\nSELECT "a", "b", "c", "d", "e"\nFROM dataset\nORDER BY 1 DESC\nLIMIT 25;'


def test_row_cap_is_in_the_plan(spark):
    many = spark.range(5000)
    _, rows = sql.query_dataset("SELECT * FROM dataset", many, timeout_seconds=60)
    assert len(rows) == 1000
    assert "Limit" in sql.capped(many)._jdf.queryExecution().optimizedPlan().toString()


def test_time_limit(spark):
    slow = "SELECT max(sha2(CAST(id AS STRING), 512)) FROM dataset"
    with pytest.raises(TimeoutError, match="Query timed out"):
        sql.query_dataset(slow, spark.range(0, 10**8, 1, 8), timeout_seconds=1)
    assert sql.query_dataset("SELECT count(*) AS n FROM dataset", spark.range(3), timeout_seconds=60)[1] == [{"n": 3}]


def test_any_statement_reaches_spark(sales):
    pairs = sql.run_sql("SELECT a.id, b.id AS other FROM dataset a CROSS JOIN dataset b", sales)
    assert sorted(tuple(r) for r in pairs.collect()) == [(1, 1), (1, 2), (2, 1), (2, 2)]


def test_preview(spark):
    assert [r["id"] for r in sql.preview(spark.range(100).orderBy("id", ascending=False), "id").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("text", ["CREATE OR REPLACE TEMP VIEW v AS SELECT 1", "DROP VIEW IF EXISTS v", "INSERT INTO dataset VALUES (1)", "SET a=b"])
def test_commands_are_refused(spark, text):
    with pytest.raises(Exception, match="PARSE_SYNTAX_ERROR"):
        sql.run_sql(text, spark.range(1))


def test_a_view_of_the_same_name_survives(spark):
    spark.range(3).createOrReplaceTempView("dataset")
    try:
        assert sql.run_sql("-- rows\nSELECT count(*) AS n FROM dataset; -- all\n", spark.range(7)).first()["n"] == 7
        assert spark.table("dataset").count() == 3
    finally:
        spark.catalog.dropTempView("dataset")
