"""Exact quantiles, modes and samples of large groups: values are narrowed down by counting, never sorted whole."""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import same_keys
from tidemark.session import scratch_path

#: Bins of a histogram, and the rows that the last bin may leave to be sorted.
BINS = 4096
LEFT_OVER = 10_000
LARGEST = sys.float_info.max
#: Hex digits by which a sample's threshold is found: a stratum's rows at the threshold are one in a million.
DIGITS = 5
SEED = 42


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def values_at(df: DataFrame, keys: list[str], value: str, wanted: DataFrame, left_over: int = LEFT_OVER) -> DataFrame:
    """keys, rank, value: each group's value at every rank of ``wanted`` (keys, rank), counted from 0 in ascending order.

    The ranks of all groups are narrowed together. In each round a rank's range of values is cut into BINS, one aggregate
    counts them all, and the bin that holds the rank becomes its range, until a range has ``left_over`` rows or one value. Only
    those are sorted. Null values are left out; NaN must not occur. Null keys are a group.
    """
    at = [f"_{k}" for k in keys]
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ends = rows.groupBy(*keys).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.count(F.lit(1)).alias("n"))
    named = wanted.select(*[F.col(k).alias(a) for k, a in zip(keys, at)], F.col("rank"), F.col("rank").alias("left"))
    open_ = _kept(named.join(ends, same_keys(at, keys)).drop(*keys), "ranks") if keys else _kept(named.join(ends, F.lit(True)), "ranks")
    finished = []
    while True:
        finished.append(open_.where((F.col("n") <= left_over) | (F.col("low") == F.col("high"))))
        open_ = open_.where((F.col("n") > left_over) & (F.col("low") < F.col("high")))
        if open_.isEmpty():
            break
        inside = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
        scope = rows.join(open_, (same_keys(keys, at) if keys else F.lit(True)) & inside)
        # Halves of values without infinities keep the widest ranges finite; the bin never falls as the value rises.
        v, low, high = (F.greatest(F.least(F.col(c), F.lit(LARGEST)), F.lit(-LARGEST)) / 2 for c in ("_v", "low", "high"))
        place = F.when(F.col("_v") == F.col("low"), 0).when(F.col("_v") == F.col("high"), BINS - 1).otherwise(
            F.least(F.floor((v - low) / F.nullif(high - low, F.lit(0.0)) * BINS), F.lit(BINS - 1))
        )
        counted = scope.groupBy(*at, "rank", "left", place.alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high")
        )
        before = Window.partitionBy(*at, "rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = counted.withColumn("skipped", F.coalesce(F.sum("n").over(before), F.lit(0)))
        hit = placed.where((F.col("skipped") <= F.col("left")) & (F.col("left") < F.col("skipped") + F.col("n")))
        open_ = _kept(hit.select(*at, "rank", (F.col("left") - F.col("skipped")).alias("left"), "low", "high", "n"), "ranks")
    done = finished[0]
    for more in finished[1:]:
        done = done.unionByName(more)
    one = done.where("low = high").select(*[F.col(a).alias(k) for k, a in zip(keys, at)], "rank", F.col("low").alias("value"))
    few = done.where("low < high")
    inside = (F.col("_v") >= F.col("low")) & (F.col("_v") <= F.col("high"))
    last = rows.join(few, (same_keys(keys, at) if keys else F.lit(True)) & inside)
    nth = F.row_number().over(Window.partitionBy(*at, "rank").orderBy("_v")) - 1
    found = last.withColumn("nth", nth).where(F.col("nth") == F.col("left"))
    return one.unionByName(found.select(*keys, "rank", F.col("_v").alias("value")))


def quantiles(df: DataFrame, keys: list[str], value: str, continuous: dict[str, float], discrete: dict[str, float] | None = None, left_over: int = LEFT_OVER) -> DataFrame:
    """keys and one column for each name: exact quantiles of each group's values, for groups and value counts of any size.

    ``continuous`` ones lie between two values in proportion, ``discrete`` ones are the first value with that share at or below.
    NaN counts as the largest value. A group without values has nulls.
    """
    discrete = discrete or {}
    v = F.col(value).cast("double")
    counts = _kept(df.groupBy(*keys).agg(F.count_if(v.isNotNull() & ~F.isnan(v)).alias("plain"), F.count(v).alias("n")), "counts")
    low, high, part = {}, {}, {}
    for name, p in continuous.items():
        spot = F.lit(p) * (F.col("n") - 1)
        low[name], high[name], part[name] = F.floor(spot), F.ceil(spot), spot - F.floor(spot)
    for name, p in discrete.items():
        low[name] = high[name] = F.greatest(F.ceil(F.lit(p) * F.col("n")) - 1, F.lit(0))
        part[name] = F.lit(0.0)
    ranks = F.array_distinct(F.array(*low.values(), *high.values()))
    wanted = counts.where("n > 0").select(*keys, F.explode(ranks).alias("rank"), "plain").where("rank < plain").drop("plain")
    plain = df.where(~F.isnan(v))
    found = values_at(plain, keys, value, wanted, left_over)
    maps = found.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))
    maps = maps.select(*[F.col(k).alias(f"_{k}") for k in keys], "_at")
    both = counts.join(maps, same_keys(keys, [f"_{k}" for k in keys]), "left") if keys else counts.join(maps, F.lit(True), "left")

    def at(rank: Column) -> Column:
        return F.when(F.col("n") == 0, F.lit(None)).when(rank >= F.col("plain"), F.lit(math.nan)).otherwise(F.element_at("_at", rank))

    out = []
    for name in (*continuous, *discrete):
        first, second = at(low[name]), at(high[name])
        out.append(F.when(part[name] == 0, first).otherwise(first + (second - first) * part[name]).alias(name))
    return both.select(*keys, *out)


def modes(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, value, times: each group's most frequent value, the least of equals. Values are counted before groups meet, so no
    group is gathered; nulls are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times"))
    best = F.min(F.struct((-F.col("times")).alias("less"), F.col(value).alias("value")))
    return counted.groupBy(*keys).agg(best.alias("best")).select(*keys, F.col("best.value").alias(value), (-F.col("best.less")).alias("times"))


def sample_rows(df: DataFrame, size: int, identity: Column, strata: list[str] | None = None, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (of each stratum; all, if it has fewer): those with the smallest md5 of seed and ``identity``.

    The choice depends on the rows alone, not on how they are dealt. The threshold is found by counting five hex digits of
    the hash; only the rows that share the threshold's digits are sorted. Rows of equal identity are told apart arbitrarily. Null strata are a stratum.
    """
    strata = strata or []
    at = [f"_{k}" for k in strata]
    placed = df.withColumn("_draw", F.md5(F.concat(F.lit(f"{seed}:"), identity).cast("binary")))
    digits = F.substring("_draw", 1, DIGITS)
    counted = placed.groupBy(*strata, digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*strata).orderBy("_digits")
    before = counted.withColumn("_before", F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    edge = before.where((F.col("_before") < size) & (F.col("_before") + F.col("_n") >= size))
    edge = edge.select(*[F.col(k).alias(a) for k, a in zip(strata, at)], F.col("_digits").alias("_edge"), (F.lit(size) - F.col("_before")).alias("_left"))
    edge = _kept(edge, "sample-edges")
    with_edge = placed.join(edge, same_keys(strata, at), "left") if strata else placed.join(edge, F.lit(True), "left")
    sure = with_edge.where(F.col("_edge").isNull() | (digits < F.col("_edge")))
    nth = F.row_number().over(Window.partitionBy(*strata).orderBy("_draw"))
    rest = with_edge.where(digits == F.col("_edge")).withColumn("_nth", nth).where(F.col("_nth") <= F.col("_left")).drop("_nth")
    return sure.unionByName(rest).select(*df.columns)
