"""CSV records from byte ranges of any size, although cells may span lines.

A range of a file does not show whether it begins inside a quoted cell. So every line reports where it
would end under both assumptions; a range is then one small function from its first state to its last,
and these functions are composed along each file to fix the state of every line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import let_workers_import, scratch_path

# A quoted cell's content, and cells that end on their line; what follows a closing quote belongs to the cell.
_INSIDE = re.compile(r'[^"]*+(?:""[^"]*+)*+')
_CLOSED = re.compile(r'(?:(?:"[^"]*+(?:""[^"]*+)*+"[^,]*+|[^",][^,]*+)?+,)*+')


def ends_inside(line: str, inside: bool) -> bool:
    """Whether a quoted cell is open at the end of a line that begins ``inside`` one or at a record's start."""
    at = 0
    if inside:
        at = _INSIDE.match(line).end()
        if at == len(line):
            return True
        at = line.find(",", at + 1) + 1
        if not at:
            return False
    at = _CLOSED.match(line, at).end()
    return line.startswith('"', at) and _INSIDE.match(line, at + 1).end() == len(line)


def running_state(block: np.ndarray, to: np.ndarray, first: int) -> np.ndarray:
    """State before every line if each block begins in state ``first``.

    ``to`` (n, 2): the state after a line, by the state before it. A line that leads to one state from
    both fixes it; after it, and after a block's start, only lines that swap the states count.
    """
    n = len(block)
    if not n:
        return np.zeros(0, np.int8)
    begins = np.append(True, block[1:] != block[:-1])
    swap = (to[:, 0] == 1) & (to[:, 1] == 0)
    swaps = np.cumsum(swap)
    fixed = to[:, 0] == to[:, 1]
    # The last place before each line where the state is known: the block's start, or after a fixing line.
    after = np.append(False, fixed[:-1])
    known = np.maximum.accumulate(np.where(begins | after, np.arange(n), 0))
    value = np.where(begins, first, np.append(0, to[:-1, 0]))[known]
    before = swaps - swap
    return (value + before - before[known]) % 2


_MARK = T.StructType()
for _side in ("plain", "quoted"):
    _MARK.add(_side, T.StructType().add("inside", T.BooleanType()).add("after", T.BooleanType()).add("start", T.LongType()))


@F.arrow_udf(_MARK)
def _marks(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """For both states of the block's start: the state before and after each line, and the line that began the record at hand.

    Lines of a block come in order, in one task; what a batch leaves open is carried to the next.
    """
    last_block, state, start = None, [0, 1], [-1, -1]
    for blocks, lines, quoted in batches:
        block = np.asarray(blocks)
        line = np.asarray(lines)
        n = len(block)
        to = np.tile(np.array([0, 1], np.int8), (n, 1))
        for i, text in zip(np.flatnonzero(np.asarray(quoted.is_valid())).tolist(), quoted.drop_null().to_pylist()):
            to[i] = ends_inside(text, False), ends_inside(text, True)
        goes_on = last_block is not None and n > 0 and block[0] == last_block
        sides = []
        for first in (0, 1):
            inside = running_state(block, to, first)
            if goes_on and state[first] != first:
                head = block == last_block
                inside[head] = running_state(block[head], to[head], state[first])
            after = to[np.arange(n), inside]
            opened = np.where(inside == 0, np.arange(n), -1)
            begins = np.append(True, block[1:] != block[:-1])[:n]
            # The last record start at or before each line, if it lies in the line's block.
            latest, edge = np.maximum.accumulate(opened) if n else opened, np.maximum.accumulate(np.where(begins, np.arange(n), 0))
            begun = np.where(latest >= edge, line[np.maximum(latest, 0)] if n else latest, -1)
            if goes_on:
                begun[(begun < 0) & (block == last_block)] = start[first]
            if n:
                state[first], start[first] = int(after[-1]), int(begun[-1])
            sides.append(
                pa.StructArray.from_arrays(
                    [pa.array(inside.astype(bool)), pa.array(after.astype(bool)), pa.array(begun, pa.int64(), mask=begun < 0)],
                    ["inside", "after", "start"],
                )
            )
        if n:
            last_block = block[-1]
        yield pa.StructArray.from_arrays(sides, ["plain", "quoted"])


def _states(lines: DataFrame) -> DataFrame:
    """_file, _block, open, record: whether each block begins inside a cell, and in which record (its block and line)."""
    last = lines.groupBy("file", "block").agg(F.max_by("mark", "line").alias("m"))
    order = Window.partitionBy("file").orderBy("block")
    upto, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    to = [F.col(f"m.{side}.after").cast("int") for side in ("plain", "quoted")]
    composed = (
        last.withColumn("swaps", F.sum(F.when((to[0] == 1) & (to[1] == 0), 1).otherwise(0)).over(upto))
        .withColumn("fixed", F.when(to[0] == to[1], (to[0] + F.col("swaps")) % 2))
        .withColumn("base", F.coalesce(F.last("fixed", ignorenulls=True).over(before), F.lit(0)))
        .withColumn("open", (F.col("base") + F.coalesce(F.lag("swaps").over(order), F.lit(0))) % 2 == 1)
    )
    start = F.when(F.col("open"), F.col("m.quoted.start")).otherwise(F.col("m.plain.start"))
    held = composed.withColumn("own", F.when(start.isNotNull(), F.struct(F.col("block").alias("block"), start.alias("line"))))
    return held.select(
        F.col("file").alias("_file"), F.col("block").alias("_block"), "open", F.last("own", ignorenulls=True).over(before).alias("record")
    )


def marked_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """folders, value, file, block, line, mark: every line with its place and its states, for whatever ranges Spark cuts."""
    let_workers_import(spark)
    text = spark.read.option("lineSep", "\n").text(path)
    folders = [c for c in text.columns if c != "value"]
    read = text.select(
        F.struct(*folders).alias("folders") if folders else F.lit(None).cast("int").alias("folders"),
        F.regexp_replace("value", "^\ufeff", "").alias("value"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    quoted = F.when(F.contains("value", F.lit('"')), F.col("value"))
    return read.withColumn("mark", _marks(F.xxhash64("file", "block"), F.col("line"), quoted))


def _kept(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def records_of(lines: DataFrame) -> DataFrame:
    """folders, record: the records of ``marked_lines`` that were written and read back."""
    states = _kept(_states(lines), "csv-states")
    placed = lines.join(states, (F.col("file") == F.col("_file")) & (F.col("block") == F.col("_block")))

    def side(name: str) -> Column:
        return F.when(F.col("open"), F.col(f"mark.quoted.{name}")).otherwise(F.col(f"mark.plain.{name}"))

    own = F.when(side("start").isNotNull(), F.struct(F.col("block").alias("block"), side("start").alias("line")))
    known = placed.select(
        "folders", "value", "file", "block", "line", side("inside").alias("inside"), side("after").alias("after"),
        F.coalesce(own, "record").alias("record"),
    )
    blank = F.rtrim(F.col("value"), F.lit("\r")) == ""
    known = known.where(F.col("inside") | ~blank)
    first = known.where(~F.col("inside")).groupBy(F.col("file").alias("_file")).agg(F.min("record").alias("header"))
    # A header's text is nulled as well as dropped: conditions on its cells may be tested before it is dropped.
    body = F.col("record") != F.col("header")
    rows = known.join(first, F.col("file") == F.col("_file")).withColumn("value", F.when(body, F.col("value"))).where(body)
    alone = rows.where(~F.col("inside") & ~F.col("after")).select("folders", F.col("value").alias("record"))
    parts = F.sort_array(F.collect_list(F.struct("block", "line", "value")))
    over_lines = rows.where(F.col("inside") | F.col("after")).groupBy("file", "record")
    joined = over_lines.agg(F.first("folders").alias("folders"), parts.alias("parts")).select(
        "folders", F.array_join("parts.value", "\n").alias("record")
    )
    return alone.unionByName(joined).withColumn("record", F.regexp_replace("record", "\r$", ""))


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """folders, record: the text of every CSV record but each file's first, its header; ``folders`` is null or a struct of the
    columns of partition folders.

    Files are cut into ranges wherever Spark cuts them and read once; lines are kept in the shared
    folder with their two states. A record on one line moves nowhere. Only the lines of records
    that span lines are gathered, record by record. Lines end with ``\\n`` or ``\\r\\n``; lines without a character between records are skipped; a
    quoted cell that is never closed runs to the end of its file.
    """
    return records_of(_kept(marked_lines(spark, path), "csv-lines"))
