"""One-hot encoding by a table of slots: no value list reaches the driver, and a slot is a row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.cells import column
from tidemark.operators.ordered import number_within
from tidemark.session import scratch_path

#: A text with one in so many cells or more is joined by broadcast; there are at most as many of those.
HEAVY = 1024


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cell_rows(cells: DataFrame, features: list[str], key: str) -> DataFrame:
    """key, feature, text, value: one row for each cell of coerced columns; ``text`` is null where the cell is a number."""
    each = [
        F.struct(F.lit(n).alias("feature"), column(f"{n}#text").alias("text"), column(f"{n}#value").alias("value")) for n in features
    ]
    return cells.select(column(key).alias("key"), F.inline(F.array(*each)))


def slot_table(cells: DataFrame, features: list[str], path: str | None = None) -> DataFrame:
    """slot, name, feature, text, n: the vector's slots in the order of their names, written to ``path``.

    A feature has the slot ``feature`` if any of its cells is a number, and one slot ``feature=text`` for every
    text among its cells. Names are numbered by range partitions and their offsets, so any number of
    distinct texts is fine. ``n`` counts the cells that belong to a slot.
    """
    # A number cell stands under a null text; a cell's text begins with "=", so names follow from both.
    found = cell_rows(cells, features, cells.columns[0]).groupBy("feature", "text").agg(F.count(F.lit(1)).alias("n"))
    named = _kept(found.withColumn("name", F.concat("feature", F.coalesce("text", F.lit("")))), "slot-names")
    numbered = number_within(named, [], [F.col("name"), F.col("feature")], "slot")
    table = numbered.select((F.col("slot") - 1).alias("slot"), "name", "feature", "text", "n")
    path = path or scratch_path(cells.sparkSession, "slots")
    table.write.mode("overwrite").parquet(path)
    return cells.sparkSession.read.schema(table.schema).parquet(path)


def encoded(cells: DataFrame, features: list[str], slots: DataFrame, key: str) -> DataFrame:
    """key, width, slots, values: every row's filled slots as a sparse vector, in slot order.

    A text that the table does not know fills no slot, nor does a number that is 0. Cells meet their
    slots by value: texts of many cells through a broadcast of at most HEAVY rows, the others by a join. ``key`` must be unique.
    """
    width = slots.count()
    total = slots.agg(F.sum("n")).first()[0] or 0
    rows = cell_rows(cells, features, key)
    known = slots.select(F.col("feature").alias("_feature"), F.col("text").alias("_text"), "slot", "n")
    often = F.col("n") * HEAVY >= total
    same = (F.col("feature") == F.col("_feature")) & F.col("text").eqNullSafe(F.col("_text"))
    heavy = F.broadcast(known.where(often).drop("n"))
    placed = rows.join(heavy, same).select("key", "slot", "text", "value")
    rest = rows.join(heavy, same, "left_anti").join(known.where(~often).drop("n"), same).select("key", "slot", "text", "value")
    value = F.when(F.col("text").isNull(), F.col("value")).otherwise(F.lit(1.0))
    filled = placed.unionByName(rest).select("key", F.struct("slot", value.alias("value")).alias("cell")).where("cell.value != 0")
    vectors = filled.groupBy("key").agg(F.sort_array(F.collect_list("cell")).alias("cells"))
    # A row whose cells fill no slot keeps an empty vector.
    keys = cells.select(column(key).alias("key"))
    found = keys.join(vectors.withColumnRenamed("key", "_key"), F.col("key").eqNullSafe(F.col("_key")), "left")
    none = F.array().cast("array<struct<slot:bigint,value:double>>")
    filled_cells = F.coalesce("cells", none)
    return found.select(
        F.col("key").alias(key), F.lit(width).cast("long").alias("width"),
        F.transform(filled_cells, lambda c: c["slot"]).alias("slots"), F.transform(filled_cells, lambda c: c["value"]).alias("values"),
    )
