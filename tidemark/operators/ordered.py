"""Order-dependent operators that do not gather a key's rows into one task.

A plain window over a key puts all its rows in one task, which fails when one key holds a
large share of the table. Each operator here cuts a key into pieces, works within the
pieces, and carries a small summary (one row per piece) from piece to piece.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.session import shared_dir

#: Rows of a piece that one task sorts, whatever the size of the table.
PIECE_ROWS = 1 << 17
#: Parts in which the rows of one position are first summed, so that a hot one spreads over tasks.
PARTS = 16


def pieces_of(rows: int) -> int:
    """Pieces for so many rows."""
    return max(1, math.ceil(rows / PIECE_ROWS))


def ranged_pieces(df: DataFrame, by: list[Column], rows: int | None = None) -> DataFrame:
    """``df`` cut into range partitions of about PIECE_ROWS rows, numbered in ``_piece``, each in one task.

    Spark samples the cut points, so a hot key spreads over many pieces; the checkpoint fixes them for all uses. Their number
    follows from the count of rows (``rows``, if known): partitions that Spark merges by bytes would be larger, and several of
    them would meet in a task.
    """
    shared_dir(df.sparkSession)
    n = pieces_of(df.count() if rows is None else rows)
    return df.repartitionByRange(n, *by).withColumn("_piece", F.spark_partition_id()).checkpoint().repartition(n, "_piece")


def same_keys(left: list[str], right: list[str]) -> Column:
    """Equality of keys under which null equals null, so that no row is lost by a join back."""
    return reduce(Column.__and__, [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "number") -> DataFrame:
    """Exact 1, 2, 3 … per key in ``order``, for keys of any size; without keys, over the whole table.

    Rows are range-partitioned by key and order (Spark samples the cut points, so a hot key
    spreads over many partitions), numbered within a partition, and shifted by the number of
    the key's rows in earlier partitions. The checkpoint fixes the cut points for both uses,
    so pass only the columns that are needed.
    """
    ranged = ranged_pieces(df, [*[F.col(k).asc_nulls_first() for k in keys], *order])
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy(*keys, "_piece")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *[F.col(k).alias(f"_at_{k}") for k in keys],
            F.col("_piece").alias("_at_piece"),
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        )
    )
    there = [f"_at_{k}" for k in keys]
    within = Window.partitionBy(*keys, "_piece").orderBy(*order)
    return (
        ranged.withColumn("_n", F.row_number().over(within))
        .join(offsets, same_keys([*keys, "_piece"], [*there, "_at_piece"]))
        .withColumn(name, F.col("_n") + F.col("_offset"))
        .drop("_piece", "_n", "_offset", "_at_piece", *there)
    )


def running_sums(df: DataFrame, keys: list[str], order: list[str], sums: list[str], rows: int | None = None) -> DataFrame:
    """``before_<name>`` for each of ``sums``: its total over the key's earlier rows in ``order``, for keys of any size.

    ``order`` must tell a key's rows apart. Rows are range-partitioned, summed within a partition, and shifted by
    the key's totals in earlier partitions. ``rows`` is their number, if known.
    """
    ranged = ranged_pieces(df, [F.col(c).asc_nulls_first() for c in (*keys, *order)], rows)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_{c}") for c in sums])
    carried = totals.select(
        *[F.col(k).alias(f"_at_{k}") for k in keys], F.col("_piece").alias("_at_piece"),
        *[F.coalesce(F.sum(f"_{c}").over(earlier), F.lit(0)).alias(f"_carried_{c}") for c in sums],
    )
    within = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    there = [f"_at_{k}" for k in keys]
    return (
        ranged.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in sums})
        .join(carried, same_keys([*keys, "_piece"], [*there, "_at_piece"]))
        .withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_carried_{c}") for c in sums})
        .drop("_piece", "_at_piece", *there, *[f"_carried_{c}" for c in sums])
    )


def asof_last(
    df: DataFrame, key: str, order: list[str], piece: Column | None, is_source: Column, value: Column, name: str,
    strict: bool = False,
) -> DataFrame:
    """For every row, the value of the key's newest source row at or before it (null if none).

    ``strict`` leaves the row itself out, which gives the previous source row.
    ``piece`` must rise with ``order`` (such as the hour of the time column): a piece of a key
    is sorted in one task, and the newest value of each piece is carried to the next ones. Without it, pieces are
    cut where the rows lie, by sampled quantiles of key and order, so that a hot hour of a key is several. Rows with
    a null key form a key of their own; null times come first.
    """
    marked = df.withColumn("_source", F.when(is_source, value))
    if piece is None:
        pieces = ranged_pieces(marked, [F.col(c).asc_nulls_first() for c in (key, *order)])
    else:
        pieces = marked.withColumn("_piece", piece)
    within = Window.partitionBy(key, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if strict else 0)
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        pieces.groupBy(key, "_piece")
        .agg(F.max_by("_source", F.when(F.col("_source").isNotNull(), F.struct(*order))).alias("_newest"))
        .select(
            F.col(key).alias("_at_key"), F.col("_piece").alias("_at_piece"),
            F.last("_newest", ignorenulls=True).over(earlier).alias("_carried"),
        )
    )
    return (
        pieces.withColumn("_here", F.last("_source", ignorenulls=True).over(within))
        .join(carried, same_keys([key, "_piece"], ["_at_key", "_at_piece"]))
        .withColumn(name, F.coalesce("_here", "_carried"))
        .drop("_piece", "_source", "_here", "_carried", "_at_key", "_at_piece")
    )


def count_in_ranges(
    points: DataFrame, ranges: DataFrame, key: str, range_id: str, at: str, low: str, high: str, width: int,
    name: str = "matches",
) -> DataFrame:
    """``range_id`` and how many of the key's points lie in (low, high]: a range join that is counted.

    Positions are whole numbers. The count is the running count at ``high`` less that at
    ``low``, so no pair of rows is ever built. Points at one position collapse first; range ends
    stand among them as rows, so the ranges are read once. A key is cut into pieces of ``width``
    positions. A range with a null key or end matches nothing and counts 0.
    """
    known = points.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    held = known.groupBy(key, F.col(at).alias("_at")).agg(F.count(F.lit(1)).alias("_points"))
    ends = ranges.select(
        F.col(range_id).alias("_range"),
        F.col(key),
        F.col(key).isNotNull() & F.col(low).isNotNull() & F.col(high).isNotNull(),
        F.inline(
            F.array(
                F.struct(F.col(low).alias("_at"), F.lit(-1).alias("_sign")),
                F.struct(F.col(high).alias("_at"), F.lit(1).alias("_sign")),
            )
        ),
    ).toDF("_range", key, "_usable", "_at", "_sign")
    # A range that can match nothing keeps its rows and takes no part in the counting.
    ends = ends.withColumn("_sign", F.when(F.col("_usable"), F.col("_sign")).otherwise(0)).drop("_usable")
    line = held.unionByName(ends.withColumn("_points", F.lit(0).cast("bigint")), allowMissingColumns=True).withColumn(
        "_piece", F.floor(F.col("_at") / width)
    )
    earlier = Window.partitionBy(key).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        line.groupBy(key, "_piece")
        .agg(F.sum("_points").alias("_rows"))
        .select(
            F.col(key).alias("_at_key"), F.col("_piece").alias("_at_piece"),
            F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        )
    )
    within = Window.partitionBy(key, "_piece").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    return (
        line.withColumn("_here", F.sum("_points").over(within))
        .where(F.col("_sign").isNotNull())
        .join(offsets, same_keys([key, "_piece"], ["_at_key", "_at_piece"]))
        .groupBy(F.col("_range").alias(range_id))
        .agg(F.sum(F.col("_sign") * (F.col("_here") + F.col("_offset"))).alias(name))
    )


def asof_join(
    left: DataFrame, right: DataFrame, key: str, at: str, right_id: str, name: str, piece: Column | None = None
) -> DataFrame:
    """The rows of ``left`` with ``name``: the ``right_id`` of the key's newest row of ``right`` at or before ``at`` (null if none).

    Both tables have ``key`` and ``at``; of right rows at one time the largest id counts. Rows of both stand in one order, so no pair is built;
    see ``asof_last`` for how keys of any size are cut.
    """
    rows = left.select(F.struct(*left.columns).alias("_row"), F.col(key), F.col(at), F.lit(1).alias("_side"), F.lit(None).cast(right.schema[right_id].dataType).alias("_id"))
    sources = right.select(F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"), F.col(key), F.col(at), F.lit(0).alias("_side"), F.col(right_id).alias("_id"))
    both = rows.unionByName(sources)
    found = asof_last(both, key, [at, "_side", "_id"], piece, F.col("_side") == 0, F.col("_id"), "_found")
    # A null key or time is before or after nothing.
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    return found.where("_side = 1").select("_row.*", F.when(known, F.col("_found")).alias(name))


def pairs_in_ranges(
    points: DataFrame, ranges: DataFrame, key: str, point_id: str, range_id: str, at: str, low: str, high: str, width: int,
    most: int = 100_000,
) -> DataFrame:
    """range_id, point_id: every pair of one key with the point in (low, high].

    Positions are whole numbers, cut into buckets of ``width``. A point has one bucket and a range all it touches, so a pair
    meets once. A bucket of a key with more than ``most`` points is dealt over several tasks, each with all its ranges.
    Null keys and positions match nothing.
    """
    held = points.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(
        F.col(key).alias("_key"), F.col(point_id), F.col(at).alias("_at"), F.floor(F.col(at) / width).alias("_bucket")
    )
    wanted = ranges.where(F.col(key).isNotNull() & (F.col(low) < F.col(high))).select(
        F.col(key).alias("_own"), F.col(range_id), F.col(low).alias("_low"), F.col(high).alias("_high"),
        F.explode(F.sequence(F.floor((F.col(low) + 1) / width), F.floor(F.col(high) / width))).alias("_place"),
    )
    crowded = held.groupBy("_key", "_bucket").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("_parts")).where("_parts > 1")
    crowded = crowded.withColumnsRenamed({"_key": "_hot_key", "_bucket": "_hot_bucket"})
    here = (F.col("_key") == F.col("_hot_key")) & (F.col("_bucket") == F.col("_hot_bucket"))
    there = (F.col("_own") == F.col("_hot_key")) & (F.col("_place") == F.col("_hot_bucket"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = held.join(crowded, here, "left").withColumn("_part", F.pmod(F.xxhash64(point_id, "_at"), parts).cast("int"))
    copied = wanted.join(crowded, there, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), parts - 1)))
    dealt, copied = (d.drop("_hot_key", "_hot_bucket", "_parts") for d in (dealt, copied))
    match = (
        (F.col("_key") == F.col("_own")) & (F.col("_bucket") == F.col("_place")) & (F.col("_part") == F.col("_copy"))
        & (F.col("_at") > F.col("_low")) & (F.col("_at") <= F.col("_high"))
    )
    return dealt.join(copied, match).select(range_id, point_id)


def framed(df: DataFrame, keys: list[str], order: list[Column], before: int, after: int, columns: dict[str, Callable[[WindowSpec], Column]], size: int = 1 << 16) -> DataFrame:
    """Window expressions over frames of ``before`` preceding and ``after`` following rows, for keys of any size.

    ``columns``: name to a function of the ordered window; it may look no further than the frame (``lag(x, before)``,
    ``sum(x).over(w.rowsBetween(-before, after))``). Rows are numbered within their key and cut into pieces of ``size``; a piece also gets
    copies of the rows before and after it that its frames reach.
    """
    size = max(size, before + after, 1)
    numbered = number_within(df, keys, order, "_position")
    place = F.col("_position") - 1
    home, inside = F.floor(place / size), place % size
    pieces = F.array_compact(F.array(home, F.when(inside >= size - before, home + 1), F.when((inside < after) & (home > 0), home - 1)))
    spread = numbered.withColumn("_home", home).withColumn("_in", F.explode(pieces))
    window = Window.partitionBy(*keys, "_in").orderBy("_position")
    done = spread.withColumns({name: make(window) for name, make in columns.items()})
    return done.where(F.col("_in") == F.col("_home")).drop("_position", "_home", "_in")


def range_frames(df: DataFrame, keys: list[str], at: str, before: Column | float, after: Column | float, sums: dict[str, Column]) -> DataFrame:
    """``df`` with sums over RANGE frames: of the key's rows whose ``at`` lies in [at - before, at + after], for keys of any size.

    ``sums``: name to a column of whole numbers or decimals (``lit(1)`` counts); sums of floats would lose digits. A frame's sum is the
    running sum at its upper end less that at its lower end, so frames may be as wide as the key and no pair of rows is built. Rows of
    one key and position collapse first, and frame ends stand among them as rows, read once. Rows without a position have each other as
    frame, as in SQL, and rows with a null key are a key. A frame without values sums to 0. ``before`` and ``after`` must not be negative, and at - before and at + after must fit
    the type of ``at``. All but the last join is cut by the count of rows, so that a task holds about as many at every size.
    """
    shared_dir(df.sparkSession)
    n = pieces_of(df.count())
    parts = df.select(*keys, at, *[c.alias(f"_v_{name}") for name, c in sums.items()])
    parts = parts.withColumn("_part", F.pmod(F.monotonically_increasing_id(), F.lit(PARTS))).repartition(n, *keys, at, "_part")
    parts = parts.groupBy(*keys, at, "_part").agg(*[F.sum(f"_v_{name}").alias(name) for name in sums])
    whole = [F.sum(name).cast(parts.schema[name].dataType).alias(name) for name in sums]
    peers = parts.repartition(n, *keys, at).groupBy(*keys, at).agg(*whole).checkpoint()
    rows = 3 * peers.count()
    ends = F.array(
        F.struct((F.col(at) - before).alias("_at"), F.lit(0).alias("_side")), F.struct((F.col(at) + after).alias("_at"), F.lit(2).alias("_side"))
    )
    ends = peers.select(*keys, F.col(at).alias("_home"), F.inline(ends))
    here = peers.select(*keys, F.col(at).alias("_home"), F.col(at).alias("_at"), F.lit(1).alias("_side"), *sums)
    line = here.unionByName(ends, allowMissingColumns=True).na.fill(0, list(sums))
    # At one position a lower end stands before the rows there, an upper end after them.
    run = running_sums(line, keys, ["_at", "_side", "_home"], list(sums), rows).where("_side != 1")
    sign = F.col("_side") - 1
    frames = run.repartition(pieces_of(rows), *keys, "_home").groupBy(*keys, "_home").agg(*[F.sum(sign * F.col(f"before_{name}")).alias(name) for name in sums])
    frames = frames.withColumnsRenamed({c: f"_f_{c}" for c in (*keys, "_home")})
    there = [f"_f_{c}" for c in (*keys, "_home")]
    return df.join(frames, same_keys([*keys, at], there)).drop(*there)


def ranked_within(df: DataFrame, keys: list[str], order: list[str], buckets: int) -> DataFrame:
    """position, rank, tile, percent_rank, cume_dist of every row in ``order`` (ascending, nulls first), for keys of any size.

    All follow from positions over the whole key: a row's rank is the first position of its equals, its cumulative share
    their last. Equal rows get positions in arbitrary order.
    """
    numbered = number_within(df, keys, [F.col(c).asc_nulls_first() for c in order], "position")
    equals = numbered.groupBy(*keys, *order).agg(F.min("position").alias("rank"), F.max("position").alias("_last"))
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    mine = [*keys, *order]
    equals = equals.withColumnsRenamed({c: f"_e_{c}" for c in mine})
    counts = counts.withColumnsRenamed({c: f"_c_{c}" for c in keys})
    joined = numbered.join(equals, same_keys(mine, [f"_e_{c}" for c in mine])).join(counts, same_keys(keys, [f"_c_{c}" for c in keys]))
    n, small, long = F.col("_rows"), F.floor(F.col("_rows") / buckets), F.col("_rows") % buckets
    edge = long * (small + 1)
    tile = F.when(F.col("position") <= edge, F.floor((F.col("position") - 1) / (small + 1)) + 1).otherwise(
        long + F.floor((F.col("position") - 1 - edge) / F.greatest(small, F.lit(1))) + 1
    )
    return joined.withColumns(
        {
            "tile": tile,
            "percent_rank": F.when(n > 1, (F.col("rank") - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0)),
            "cume_dist": F.col("_last") / n,
        }
    ).drop("_last", "_rows", *[f"_e_{c}" for c in mine], *[f"_c_{c}" for c in keys])
