"""Merged states against profiles and statistics of the whole table."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.operators import profile, states, stats
from tidemark.session import scratch_path

SCHEMA = "part int, k long, t string, d date, v double, m decimal(12,2), b boolean, ts timestamp_ntz"
DAY, TIME = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 1, 2, 3)
ROWS = [
    (0, 9007199254740993, "1", DAY, 0.0, Decimal("1.50"), True, TIME),
    (0, 9007199254740992, " 2 ", None, -0.0, Decimal("-2.25"), None, None),
    (0, None, "", None, None, None, None, None),
    (1, 9007199254740993, "1", DAY, 0.0, Decimal("1.50"), True, TIME),
    (1, 5, "x" * 100, DAY, float("nan"), Decimal("1.50"), False, TIME),
    (1, None, None, None, None, None, None, None),
    (2, 5, "x" * 100, DAY, float("nan"), Decimal("1.50"), False, TIME),
    (2, -7, "x" * 99 + "y", DAY, 1.25, None, False, TIME),
]


def _merged(spark, df, parts):
    path = scratch_path(spark, "states")
    for version, part in enumerate(parts):
        states.append_state(df.where(F.col("part").isin(part)).drop("part"), path, version)
    return states.read_states(spark, path), path


def _same(spark, df, figures, keys):
    whole = df.drop("part")
    found = states.merged_statistics(figures, keys, whole.schema).orderBy("position")
    wanted = stats.column_statistics(whole).orderBy("position")
    assert found.schema.simpleString() == wanted.schema.simpleString()
    assert str(found.collect()) == str(wanted.collect())
    assert states.merged_profile(figures, keys, whole.columns).collect() == profile.profile_table(whole).collect()


@pytest.mark.parametrize("parts", [[[0, 1, 2]], [[0], [1], [2]], [[2], [0, 1]], [[0, 1, 2], [9]], [[9]]])
def test_merged_equals_whole(spark, parts):
    df = spark.createDataFrame(ROWS, SCHEMA)
    (figures, keys), _ = _merged(spark, df, parts)
    _same(spark, df.where(F.col("part").isin([p for part in parts for p in part])), figures, keys)


def test_a_version_written_again_replaces_itself_and_an_unfinished_one_is_not_read(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    _, path = _merged(spark, df, [[0], [1, 2]])
    states.append_state(df.where("part = 1").drop("part"), path, 1)
    states.keys_of(df.where("part = 2").drop("part")).write.parquet(f"{path}/keys/version=2")
    _same(spark, df.where("part < 2"), *states.read_states(spark, path))


def test_appending_reads_only_what_is_appended(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    _, path = _merged(spark, df, [[0], [1]])
    before = {f: f.stat().st_mtime_ns for f in _files(path)}
    states.append_state(df.where("part = 2").drop("part"), path, 2)
    assert {f: t for f, t in ((f, f.stat().st_mtime_ns) for f in _files(path)) if f in before} == before
    _same(spark, df, *states.read_states(spark, path))


def _files(path):
    from pathlib import Path

    return list(Path(path.removeprefix("file:")).rglob("*.parquet"))


def test_text_cells_decide_types_over_all_appends(spark):
    df = spark.createDataFrame([(0, "1"), (0, "2"), (1, "2.5"), (2, "word"), (2, "1")], "part int, t string")
    for parts, kind in (([[0]], "integer"), ([[0], [1]], "number"), ([[0], [1], [2]], "string")):
        (figures, keys), _ = _merged(spark, df, parts)
        rows = states.merged_profile(figures, keys, ["t"]).select(F.inline("columns")).collect()
        assert [r["inferred_type"] for r in rows] == [kind]
        _same(spark, df.where(F.col("part").isin([p for part in parts for p in part])), figures, keys)


def test_every_generated_method_is_small_enough_to_be_compiled(spark):
    columns = [F.col("id").alias(f"k{i}") for i in range(4)] + [(F.col("id") / (i + 2)).alias(f"v{i}") for i in range(4)]
    columns += [F.concat(F.lit("t"), "id").alias(f"t{i}") for i in range(4)]
    wide = spark.range(8).select(columns)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        stages = debug.codegenStringSeq(states.keys_of(wide)._jdf.queryExecution().executedPlan())
        sizes = [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.length())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sizes and max(sizes) <= 8000
