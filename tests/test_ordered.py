"""Order-dependent operators against brute force, with one key holding a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered
from tidemark.operators.ordered import asof_last, count_in_ranges, number_within, range_frames
from tidemark.operators.registry import newest_first_page, newest_per_key, replace_open
from tidemark.operators.trees import held_out_rows, split_with_total

ROWS = 900


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    return [(0 if i % 3 == 0 else rng.randrange(1, 40), rng.randrange(0, 300), i, rng.random() < 0.3) for i in range(ROWS)]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k int, at long, id int, mark boolean").repartition(9)


def test_number_within(frame, data):
    expected = {}
    for k in {r[0] for r in data}:
        for n, row in enumerate(sorted((r[1], r[2]) for r in data if r[0] == k), 1):
            expected[row[1]] = n
    got = number_within(frame, ["k"], [F.col("at"), F.col("id")]).collect()
    assert {r["id"]: r["number"] for r in got} == expected


def test_number_over_whole_table(frame, data):
    order = [i for _, i in sorted(((r[1], r[2]) for r in data), reverse=True)]
    got = number_within(frame, [], [F.col("at").desc(), F.col("id").desc()]).collect()
    assert [r["id"] for r in sorted(got, key=lambda r: r["number"])] == order


def test_later_pages_come_in_order(frame, data):
    order = [i for _, i in sorted(((r[1], r[2]) for r in data), reverse=True)]
    got = newest_first_page(frame, "at", "id", limit=20, offset=333).collect()
    assert [r["id"] for r in got] == order[333:353]


def test_null_keys_and_times_stay(spark):
    rows = [(None, 1, 1), (None, 2, 2), ("a", None, 3), ("a", 5, 4)]
    df = spark.createDataFrame(rows, "k string, at long, id long")
    numbered = {r["id"]: r["number"] for r in number_within(df, ["k"], [F.col("at"), F.col("id")]).collect()}
    assert numbered == {1: 1, 2: 2, 3: 1, 4: 2}
    found = asof_last(df, "k", ["at", "id"], F.floor(F.col("at") / 20), F.col("id") < 4, F.col("id"), "found")
    assert {r["id"]: r["found"] for r in found.collect()} == {1: 1, 2: 2, 3: 3, 4: 3}
    ranges = spark.createDataFrame([(1, "a", 0, 9), (2, None, 0, 9), (3, "a", None, 9), (4, "b", 0, 9)], "r long, k string, low long, high long")
    counted = count_in_ranges(df, ranges, "k", "r", "at", "low", "high", 4)
    assert {r["r"]: r["matches"] for r in counted.collect()} == {1: 1, 2: 0, 3: 0, 4: 0}


def test_more_rows_per_key_than_the_group_limit(spark):
    df = spark.range(5000).selectExpr("id % 2 AS k", "id")
    got = newest_per_key(df, ["k"], [F.col("id").desc()], rows=1001)
    assert "WindowGroupLimit" not in got._jdf.queryExecution().toString()
    assert sorted(r["id"] for r in got.collect()) == list(range(2998, 5000))


def test_regeneration_keeps_other_rows_once(spark):
    existing = spark.createDataFrame([(1, "open"), (1, "done"), (1, None), (2, "open"), (None, "open")], "workspace_id long, status string")
    twice = spark.createDataFrame([(1,), (1,)], "workspace_id long")
    got = replace_open(existing, existing.limit(0), twice).collect()
    assert sorted(map(str, got)) == sorted(map(str, [r for r in existing.collect() if (r[0], r[1]) != (1, "open")]))


def test_page_limits(frame):
    for limit, offset in ((0, 0), (1001, 0), (10, -1)):
        with pytest.raises(ValueError):
            newest_first_page(frame, "at", "id", limit, offset)


@pytest.mark.parametrize("strict", [False, True])
def test_asof_last(frame, data, strict):
    expected = {}
    for k, at, i, _ in data:
        before = [(a, j) for kk, a, j, m in data if kk == k and m and ((a, j) < (at, i) if strict else (a, j) <= (at, i))]
        expected[i] = max(before)[1] if before else None
    got = asof_last(frame, "k", ["at", "id"], F.floor(F.col("at") / 20), F.col("mark"), F.col("id"), "found", strict).collect()
    assert {r["id"]: r["found"] for r in got} == expected


def test_count_in_ranges(frame, data):
    ranges = frame.where("mark").select("k", "id", F.col("at").alias("low"), (F.col("at") + 25).alias("high"))
    expected = {i: sum(kk == k and at < a <= at + 25 for kk, a, _, _ in data) for k, at, i, m in data if m}
    got = count_in_ranges(frame, ranges, "k", "id", "at", "low", "high", 10).collect()
    assert {r["id"]: r["matches"] for r in got} == expected


@pytest.mark.parametrize("spread", [1, 4])
def test_newest_per_key(frame, data, spread):
    expected = set()
    for k in {r[0] for r in data}:
        expected |= {i for _, i in sorted(((r[1], r[2]) for r in data if r[0] == k), reverse=True)[:5]}
    got = newest_per_key(frame, ["k"], [F.col("at").desc(), F.col("id").desc()], 5, spread=spread).collect()
    assert {r["id"] for r in got} == expected


def test_newest_per_key_is_cut_before_the_shuffle(frame):
    plan = newest_per_key(frame, ["k"], [F.col("at").desc()], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize("share", [0.0, 0.33, 0.5, 1.0])
def test_split_is_exact_and_stable(spark, share):
    for rows in (2, 6, 1000):
        df = spark.range(rows)
        split, total = split_with_total(df, "id", share)
        again, _ = split_with_total(df.repartition(5), "id", share)
        chosen = {r["id"] for r in split.where("is_test").collect()}
        assert total == rows and len(chosen) == held_out_rows(rows, share)
        assert chosen == {r["id"] for r in again.where("is_test").collect()}


@pytest.mark.parametrize("before, after", [(0, 0), (5, 3), (0, 1000), (1000, 0), (1000, 1000)])
def test_range_frames(spark, before, after):
    draw = random.Random(before + after)
    rows = [("hot" if draw.random() < 0.7 else draw.choice(["a", None]), draw.choice([None, *range(-40, 40)]), draw.choice([None, 1, -2, 30]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, x long, v int, id int")
    got = range_frames(df, ["k"], "x", before, after, {"total": F.col("v"), "n": F.lit(1)}).collect()
    assert len(got) == len(rows)
    for r in got:
        frame = [v for k, x, v, _ in rows if k == r.k and (x is None if r.x is None else x is not None and r.x - before <= x <= r.x + after)]
        assert (r.total, r.n) == (sum(v or 0 for v in frame), len(frame))


def test_range_frames_of_decimals_and_of_nothing(spark):
    df = spark.sql("SELECT * FROM VALUES ('k', 1.5D, 0.10BD), ('k', 2.0D, 0.25BD), ('k', 9.0D, 1.00BD) AS t(k, x, v)")
    got = {r.x: str(r.total) for r in range_frames(df, ["k"], "x", 0.5, 0.0, {"total": F.col("v")}).collect()}
    assert got == {1.5: "0.10", 2.0: "0.35", 9.0: "1.00"}
    assert range_frames(df.limit(0), ["k"], "x", 1, 1, {"total": F.col("v")}).count() == 0


def test_pieces_follow_the_count_of_rows(spark, monkeypatch):
    """Before, Spark merged small range partitions by bytes, so that a task's rows grew with the table."""
    monkeypatch.setattr(ordered, "PIECE_ROWS", 1000)
    lines = spark.range(60_000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id"))
    cut = ordered.ranged_pieces(lines, [F.col("k"), F.col("at")])
    sizes = [r["n"] for r in cut.groupBy("_piece").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 60_000 and len(sizes) > 50 and max(sizes) < 3000
    spread = cut.groupBy(F.spark_partition_id().alias("task")).agg(F.countDistinct("_piece").alias("n")).collect()
    assert max(r["n"] for r in spread) < 10


def test_many_pieces_give_the_results_of_one(spark, frame, data, monkeypatch):
    schema = frame.schema
    rows = [*data, (None, 5, 900, True), (None, 7, 901, False), (0, None, 902, True), (0, None, 903, False)]
    rows = spark.createDataFrame(rows, schema).repartition(5)

    def results():
        order = [F.col("at").asc_nulls_first(), F.col("id")]
        frames = range_frames(rows, ["k"], "at", 20, 3, {"n": F.lit(1), "total": F.col("id"), "cents": F.col("id").cast("decimal(12,2)")})
        found = [
            number_within(rows, ["k"], order),
            asof_last(rows, "k", ["at", "id"], None, F.col("mark"), F.col("id"), "found"),
            frames,
        ]
        assert frames.schema["cents"].dataType.simpleString() == "decimal(38,2)"
        return [sorted(map(str, f.collect())) for f in found]

    few = results()
    monkeypatch.setattr(ordered, "PIECE_ROWS", 40)
    assert results() == few
