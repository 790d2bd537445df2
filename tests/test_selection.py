"""Quantiles, modes, samples, frames, ranks, as-of and range pairs against brute force, with one key holding a third of the rows."""

import bisect
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ordered, selection

ROWS = 600


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    return [
        ("hot" if i % 3 == 0 else rng.choice(["a", "b", None]), rng.choice([rng.uniform(-1e6, 1e6), 5.0, 5.0, -0.0, 1e308, -1e308, math.inf]), i, rng.randrange(0, 40))
        for i in range(ROWS)
    ]


@pytest.fixture(scope="module")
def frame(spark, data):
    return spark.createDataFrame(data, "k string, v double, id int, t long").repartition(7)


def groups(data):
    out = {}
    for row in data:
        out.setdefault(row[0], []).append(row)
    return out


@pytest.mark.parametrize("left_over", [20, 10_000])
def test_quantiles(frame, data, left_over, monkeypatch):
    monkeypatch.setattr(selection, "BINS", 64)
    plain = [(k, v if math.isfinite(v) else 7.0) for k, v, *_ in data]
    finite = frame.withColumn("v", F.when(F.abs("v") < math.inf, F.col("v")).otherwise(7.0))
    got = {r["k"]: r for r in selection.quantiles(finite, ["k"], "v", {"m": 0.5, "p90": 0.9}, {"p25": 0.25}, left_over).collect()}
    for k, rows in groups(plain).items():
        values = sorted(v for _, v in rows)
        for name, p in (("m", 0.5), ("p90", 0.9)):
            spot = p * (len(values) - 1)
            low, high = values[math.floor(spot)], values[math.ceil(spot)]
            assert got[k][name] == pytest.approx(low + (high - low) * (spot - math.floor(spot)))
        assert got[k]["p25"] == values[math.ceil(0.25 * len(values)) - 1]
    whole = selection.quantiles(finite, [], "v", {"m": 0.5}, left_over=left_over).first()
    assert whole["m"] == pytest.approx(float(np.quantile([v for _, v in plain], 0.5)))


def test_quantiles_of_odd_values(spark):
    rows = [("inf", math.inf), ("inf", -math.inf), ("inf", 1.0), ("none", None), ("nan", math.nan), ("nan", 1.0), ("one", 4.0)] + [("inf", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: (r["low"], r["mid"], r["top"]) for r in selection.quantiles(df, ["k"], "v", {}, {"low": 0.0, "mid": 0.5, "top": 1.0}, 2).collect()}
    assert got["inf"] == (-math.inf, 19.0, math.inf) and got["none"] == (None, None, None) and got["one"] == (4.0, 4.0, 4.0)
    assert got["nan"][:2] == (1.0, 1.0) and math.isnan(got["nan"][2])
    assert selection.quantiles(df.limit(0), ["k"], "v", {"m": 0.5}).count() == 0


def test_modes(frame, data):
    got = {r["k"]: (r["v"], r["times"]) for r in selection.modes(frame, ["k"], "v").collect()}
    for k, rows in groups(data).items():
        counts = Counter(v for _, v, *_ in rows)
        assert got[k] == min(((v, n) for v, n in counts.items()), key=lambda item: (-item[1], item[0]))


def test_sample_is_exact_and_independent_of_partitions(spark, frame, data):
    def draw(i):
        return hashlib.md5(f"42:{i}".encode()).hexdigest()

    for df in (frame, frame.repartition(3)):
        got = sorted(r["id"] for r in selection.sample_rows(df, 100, F.col("id").cast("string")).collect())
        assert got == sorted(sorted(range(ROWS), key=draw)[:100])
    got = Counter((r["k"], r["id"]) for r in selection.sample_rows(frame, 70, F.col("id").cast("string"), ["k"]).collect())
    assert got == Counter((k, r[2]) for k, rows in groups(data).items() for r in sorted(rows, key=lambda r: draw(r[2]))[:70])
    assert selection.sample_rows(frame, 5000, F.col("id").cast("string")).count() == ROWS
    equal = spark.range(500).select(F.lit("same").alias("c"))
    assert selection.sample_rows(equal, 33, F.col("c")).count() == 33 and selection.sample_rows(equal.limit(0), 33, F.col("c")).count() == 0


@pytest.mark.parametrize("size", [7, 1 << 16])
def test_frames_over_pieces(frame, data, size):
    columns = {
        "total": lambda w: F.sum("id").over(w.rowsBetween(-3, 2)), "before": lambda w: F.lag("id", 3).over(w), "later": lambda w: F.lead("id", 2).over(w),
    }
    got = {r["id"]: r for r in ordered.framed(frame, ["k"], [F.col("t"), F.col("id")], 3, 2, columns, size).collect()}
    assert len(got) == ROWS
    for rows in groups(data).values():
        ids = [i for _, i in sorted((r[3], r[2]) for r in rows)]
        for n, i in enumerate(ids):
            assert got[i]["total"] == sum(ids[max(0, n - 3) : n + 3])
            assert got[i]["before"] == (ids[n - 3] if n >= 3 else None) and got[i]["later"] == (ids[n + 2] if n + 2 < len(ids) else None)


def test_ranks_and_shares(frame, data):
    got = {r["id"]: r for r in ordered.ranked_within(frame, ["k"], ["t"], 7).collect()}
    for rows in groups(data).values():
        times = sorted(r[3] for r in rows)
        n = len(rows)
        for r in rows:
            first, last = bisect.bisect_left(times, r[3]), bisect.bisect_right(times, r[3])
            assert got[r[2]]["rank"] == first + 1 and got[r[2]]["percent_rank"] == pytest.approx(first / (n - 1))
            assert got[r[2]]["cume_dist"] == pytest.approx(last / n) and first < got[r[2]]["position"] <= last
        tiles = Counter(got[r[2]]["tile"] for r in rows)
        assert sorted(tiles) == list(range(1, 8)) and [tiles[t] for t in range(1, 8)] == sorted(tiles.values(), reverse=True)
        assert max(tiles.values()) - min(tiles.values()) <= 1


def test_running_sums(frame, data):
    got = {r["id"]: r["before_t"] for r in ordered.running_sums(frame, ["k"], ["id"], ["t"]).collect()}
    for rows in groups(data).values():
        total = 0
        for r in sorted(rows, key=lambda r: r[2]):
            assert got[r[2]] == total
            total += r[3]


@pytest.mark.parametrize("most", [5, 100_000])
def test_range_pairs(spark, frame, data, most):
    spans = [(i, k, low, low + 1 + i % 13) for i, (k, _, _, low) in enumerate(data[:90])] + [(900, "hot", None, 5), (901, "hot", 9, 9), (902, "z", 0, 99)]
    ranges = spark.createDataFrame(spans, "r int, k string, low long, high long")
    got = Counter(tuple(r) for r in ordered.pairs_in_ranges(frame, ranges, "k", "id", "r", "t", "low", "high", 6, most).collect())
    want = Counter((r, row[2]) for r, k, low, high in spans for row in data if k is not None and row[0] == k and low is not None and low < row[3] <= high)
    assert got == want


def test_asof_over_two_tables_and_pieces_of_a_hot_hour(spark, frame, data):
    left = [(i, data[i][0], data[i][3]) for i in range(0, 200)] + [(5000, "hot", None), (5001, "z", 3)]
    asked = spark.createDataFrame(left, "q int, k string, t long")
    got = {r["q"]: r["found"] for r in ordered.asof_join(asked, frame, "k", "t", "id", "found").collect()}
    for q, k, t in left:
        at = [(r[3], r[2]) for r in data if r[0] == k and k is not None and t is not None and r[3] <= t]
        assert got[q] == (max(at)[1] if at else None)
    # All rows of one key lie in one hour: fixed pieces would make one task, these make several.
    hot = spark.range(40_000).selectExpr("'hot' AS k", "id AS t", "CAST(id AS INT) AS id", "id % 3 = 0 AS mark").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = ordered.asof_last(hot, "k", ["t"], None, F.col("mark"), F.col("id"), "found", strict=True)
        pieces = hot.repartitionByRange("k", "t").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found.where((F.col("id") > 0) & (F.col("found") != F.floor((F.col("id") - 1) / 3) * 3)).count() == 0
    assert len(pieces) > 4 and max(r["count"] for r in pieces) < 20_000
