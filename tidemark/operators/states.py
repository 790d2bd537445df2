"""Profiles and statistics of a table that grows: each append leaves a state, and states are merged without a rescan.

A state has two tables. ``figures`` is one row: counts, sums and ranges of all columns, in the columns' own
types. ``keys`` has one row for each distinct cell of a column (position 0, 1, …) and for each distinct row of the table
(position -1), as keys of 32 bytes at most with their copies. Figures add up; keys of several states meet in one grouping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.cells import stripped
from tidemark.operators.profile import assembled, blank_row, column_rows, column_totals, row_digest
from tidemark.operators.stats import STATISTICS, cell_figures, cell_keys, figure_rows

ROW = -1
#: How a figure of several states becomes one; its name is one of these letters and the column's position.
MERGES = {"n": F.sum, "w": F.sum, "m": F.sum, "i": F.sum, "f": F.sum, "s": F.sum, "l": F.min, "h": F.max, "a": F.min, "z": F.max}


def figures_of(df: DataFrame) -> DataFrame:
    """One row of figures, by one plain aggregate: a row per task is shuffled. A table without rows has zeros and nulls."""
    df = stripped(df)
    totals = [F.count(F.lit(1)).alias("rows"), *column_totals(df.schema)]
    for i, field in enumerate(df.schema.fields):
        cell, words, number = cell_figures(field)
        # Whole numbers add up as doubles, as in a mean: a sum of longs could overflow.
        addend = number if isinstance(field.dataType, T.DecimalType) else number.cast("double")
        totals += [
            F.count(cell).alias(f"n{i}"), F.coalesce(words, F.lit(0)).cast("long").alias(f"w{i}"), F.sum(addend).alias(f"s{i}"),
            F.min(number).alias(f"l{i}"), F.max(number).alias(f"h{i}"), F.min(cell).alias(f"a{i}"), F.max(cell).alias(f"z{i}"),
        ]
    return df.agg(*totals)


def keys_of(df: DataFrame) -> DataFrame:
    """position, value, blank, copies: the distinct cells and rows of a table; copies collapse before the shuffle.

    Rows are grouped by themselves, and so are the columns of each table of ``cell_keys``; the table is read once for each.
    """
    df = stripped(df)
    rows = df.select(F.lit(ROW).alias("position"), row_digest(df.schema).alias("value"), blank_row(df.schema).alias("blank"))
    cells = [keys.withColumn("blank", F.lit(False)) for keys in cell_keys(df)]
    return reduce(DataFrame.unionByName, [_copies(found) for found in (rows, *cells)])


def _copies(found: DataFrame) -> DataFrame:
    return found.groupBy("position", "value", "blank").agg(F.count(F.lit(1)).alias("copies"))


def append_state(df: DataFrame, path: str, version: int) -> None:
    """Write the state of the appended rows ``df`` under ``path``; the same version again replaces its own state.

    Only ``df`` is read. The figures are written last and make the version count, so a failed append leaves nothing that is read.
    """
    keys_of(df).write.mode("overwrite").parquet(f"{path}/keys/version={version}")
    figures_of(df).write.mode("overwrite").parquet(f"{path}/figures/version={version}")


def read_states(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(figures, keys) of all versions under ``path`` whose append has ended."""
    figures = spark.read.parquet(f"{path}/figures")
    return figures, spark.read.parquet(f"{path}/keys").join(figures.select("version"), "version", "left_semi")


def merged_figures(figures: DataFrame) -> DataFrame:
    """One row of figures from any number of them."""
    merges = [MERGES[c[0]](c).alias(c) for c in figures.columns if c not in ("rows", "version")]
    return figures.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *merges)


def merged_keys(keys: DataFrame) -> DataFrame:
    """The distinct cells and rows of all states together, with all their copies."""
    return keys.groupBy("position", "value", "blank").agg(F.sum("copies").alias("copies"))


def merged_statistics(figures: DataFrame, keys: DataFrame, schema: T.StructType) -> DataFrame:
    """What ``column_statistics`` says of a table with this ``schema``, from its states."""

    def shown(i: int, field: T.StructField) -> list[Column]:
        low, high, mean = F.col(f"l{i}"), F.col(f"h{i}"), F.col(f"s{i}") / F.when(F.col(f"n{i}") > 0, F.col(f"n{i}"))
        return [
            F.col(f"n{i}"), F.col(f"w{i}"), low.cast("double").alias(f"l{i}"), high.cast("double").alias(f"h{i}"), mean.cast("double").alias(f"m{i}"),
            F.col(f"a{i}").cast("string").alias(f"a{i}"), F.col(f"z{i}").cast("string").alias(f"z{i}"),
            low.cast("string").alias(f"le{i}"), high.cast("string").alias(f"he{i}"),
        ]

    wide = merged_figures(figures).where("rows > 0")
    wide = wide.select("rows", *[c for i, f in enumerate(schema.fields) for c in shown(i, f)])
    distinct = merged_keys(keys.where(F.col("position") > ROW)).groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))
    rows = wide.select(F.inline(figure_rows(schema.fields)))
    return rows.join(distinct, "position", "left").na.fill(0, ["distinct_count"]).select(*STATISTICS)


def merged_profile(figures: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """What ``profile_table`` says of a table with these columns, from its states."""
    columns = merged_figures(figures).withColumnRenamed("rows", "n").where("n > 0").select(F.inline(column_rows(names)))
    totals = merged_keys(keys.where(F.col("position") == ROW)).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("row_count"),
        F.count(F.lit(1)).alias("distinct_rows"),
        F.coalesce(F.sum(F.when(F.col("blank"), F.col("copies"))), F.lit(0)).alias("blank_rows"),
    )
    return assembled(columns, totals, len(names))
