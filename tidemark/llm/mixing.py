"""Mixing sources to target weights by capped water-filling, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.staging import staged
from tidemark.operators.ordered import number_within

WEIGHTS = (1, 2, 3)
MOST_EPOCHS = 3
SEED = 23
WORD = r"[^\x20\x09-\x0D]+"
#: Leading hex digits of a draw that bin a source's rows before its cut is looked for.
BIN_DIGITS = 3


def word_count(text: Column) -> Column:
    """Words of a text; none if it is null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, key: Column, text: Column) -> Column:
    """A seeded position in the random order of rows: 32 hex digits, fixed by key and text."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string"), F.md5(F.coalesce(text, F.lit("")))))


def source_targets(
    sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, share: float = 1.0
) -> DataFrame:
    """source, source_size, target for ``sized`` (source, size): capped water-filling.

    Sources in code-point order, null last, weigh ``weights``, repeating, and share ``share`` of all
    sizes (1.0 or less than ``epochs``). A source whose part is more than ``epochs`` times its size is
    clamped there, and what is left is shared among the others by weight, again and again until none
    is above. Each pass is one aggregate over the table of sources; one row comes to the driver.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = number_within(sources.withColumn("_last", F.col("source").isNull()), [], [F.col("_last"), F.col("source")])
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("number") - 1) % len(weights) + 1).cast("int"))
    table = staged(
        ranked.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("cap")),
        "sources",
    )
    total = table.agg(F.sum("source_size").alias("all")).first()["all"] or 0
    total = total if share == 1.0 else int(total * share)
    clamped, left, heavy = F.lit(False), total, None
    while True:
        # cap < left * weight / heavy, in whole numbers
        state = table.agg(
            F.coalesce(F.sum(F.when(clamped, F.col("cap"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~clamped, F.col("weight"))), F.lit(0)).alias("heavy"),
            F.count(F.when(clamped, True)).alias("n"),
        ).first()
        if heavy is not None and state["n"] == before:
            break
        before, left, heavy = state["n"], total - state["capped"], state["heavy"]
        clamped = F.col("cap").cast("decimal(38,0)") * F.lit(heavy) < F.lit(left).cast("decimal(20,0)") * F.col("weight")
        clamped = clamped | F.lit(heavy == 0)
    share_of = (F.col("weight") * F.lit(left)).cast("double") / F.lit(float(heavy or 1))
    return table.select(
        "source", "source_size", F.when(clamped, F.col("cap").cast("double")).otherwise(share_of).alias("target")
    )


def cuts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """source, source_size, target, whole, cut: take each row ``whole`` times, and once more if its draw is at most ``cut``.

    The rows up to the cut hold the words that whole repetitions leave open, to the nearest row. A
    source's sizes are binned by draw first, so that only the rows of the bin with the cut are sorted.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    wanted = targets.withColumn("whole", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long")).withColumn(
        "open", F.col("target") - F.col("whole") * F.col("source_size")
    )
    wanted = staged(wanted, "wanted")
    in_bin = F.substring("draw", 1, BIN_DIGITS)
    bins = sized.groupBy("source", in_bin.alias("bin")).agg(F.sum("size").alias("bin_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    same = wanted["source"].eqNullSafe(F.col("_source"))
    edge = (
        bins.withColumn("before", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
        .withColumnRenamed("source", "_source")
        .join(wanted, same)
        .where((F.col("before") < F.col("open")) & (F.col("before") + F.col("bin_size") >= F.col("open")))
        .select("_source", "bin", "before", "open")
    )
    edge = staged(edge, "edges")
    upto = Window.partitionBy("_source").orderBy("draw").rangeBetween(Window.unboundedPreceding, 0)
    inside = (
        sized.join(edge, F.col("source").eqNullSafe(F.col("_source")) & (in_bin == F.col("bin")))
        .groupBy("_source", "draw", "before", "open")
        .agg(F.sum("size").alias("size"))
        .withColumn("upto", F.sum("size").over(upto) + F.col("before"))
        .where(F.col("upto") - F.col("size") / 2 <= F.col("open"))
        .groupBy("_source")
        .agg(F.max("draw").alias("cut"))
    )
    # Nothing of the bin fits: all rows of the bins before it.
    found = edge.join(inside.withColumnRenamed("_source", "_found"), F.col("_source").eqNullSafe(F.col("_found")), "left")
    found = found.select("_source", F.coalesce("cut", "bin").alias("cut"))
    return wanted.join(found, same, "left").select("source", "source_size", "target", "whole", "cut")


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = MOST_EPOCHS, share: float = 1.0, seed: int = SEED,
    text: str = "text", key: str = "doc_id", source: str = "source",
) -> DataFrame:
    """``record`` (every column of ``docs``), ``size``, ``source_size``, ``target``, ``times``: the mix.

    ``times`` is how often the mix repeats the row: the source's whole repetitions and, for the rows
    first in the seeded order, one more. Reruns agree, in any partitioning. Rows equal in key and text
    share a draw and so are taken alike. A null source is a source of its own, a null text has size 0; a source
    without words has target 0 and is not taken. A very long text is taken or left whole, so it may move its source off target by half
    its size. An empty table gives no rows.
    """
    rows = docs.select(
        F.struct("*").alias("record"),
        F.col(source).alias("source"),
        word_count(F.col(text)).alias("size"),
        draw(seed, F.col(key), F.col(text)).alias("draw"),
    )
    sized = staged(rows.select("source", "size", "draw"), "sized")
    plan = staged(cuts(sized, source_targets(sized, weights, epochs, share)), "cuts").withColumnRenamed("source", "_source")
    once_more = F.coalesce(F.col("draw") <= F.col("cut"), F.lit(False)).cast("long")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("_source"))).select(
        "record", "size", "source_size", "target", (F.col("whole") + once_more).alias("times")
    )
