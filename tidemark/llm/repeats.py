"""Repeated byte strings across all texts, by hashes of the windows of one length and of anchors in them."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import SEGMENT, flat, owners, range_hashes, run_starts
from tidemark.llm.staging import let_workers_import, staged
from tidemark.session import scratch_path

THRESHOLD = 400
#: Bytes of an anchor.
ANCHOR = 256
#: Text and rows of a part: what one task holds at a time. A longer text is a part of its own.
PART_BYTES = 8 << 20
PART_ROWS = 1 << 20
_POSITION = np.uint64((1 << 24) - 1)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` values in a row."""
    n = len(values)
    rows = np.concatenate([values, np.full(-n % width, ~np.uint64(0))]).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def spans(data: np.ndarray, offsets: np.ndarray, length: int = THRESHOLD, anchor: int = ANCHOR) -> Iterator[tuple]:
    """(start, windows, anchor hash, span hash) arrays: runs of windows that share an anchor.

    The anchor of a window is the ``anchor`` bytes in it with the least hash: equal windows have equal
    anchors at equal places. The span of a run is all bytes of its windows, so runs with equal spans
    have equal windows. A run also ends where the data are cut into segments, which only makes
    its span another one.
    """
    width = length - anchor + 1
    for low in range(0, len(data) - length + 1, SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        at = np.arange(len(part) - anchor + 1)
        hashes = range_hashes(part, at, at + anchor)
        place = (_least(hashes & ~_POSITION | at.astype(np.uint64), width) & _POSITION).astype(np.int64)
        start = np.arange(len(place))
        text = owners(offsets, low + start)
        inside = low + start + length <= offsets[text + 1]
        change = np.ones(len(place) + 1, bool)
        change[1:-1] = (place[1:] != place[:-1]) | (text[1:] != text[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(change[:-1] & inside)
        last = np.flatnonzero(change[1:] & inside)
        yield low + first, last - first + 1, hashes[place[first]], range_hashes(part, first, last + length)


def _all_spans(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int) -> list[np.ndarray]:
    found = list(zip(*spans(data, offsets, length, anchor)))
    none = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 2
    return [np.concatenate(x) for x in found] if found else none


def _repeated_here(digit: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of spans in one part: which occur twice or more in it, and one place for every distinct span."""
    order = np.lexsort((span, digit))
    new = run_starts(digit[order], span[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return np.bincount(group, minlength=1)[group] > 1 if len(order) else new, order[new]


def _hash_windows(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """range_hashes of the windows at rising ``starts``, segment by segment."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + SEGMENT)))
        low = starts[i]
        out[i:j] = range_hashes(data[low : starts[j - 1] + length], starts[i:j] - low, starts[i:j] - low + length)
        i = j
    return out


def _runs(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first, first + 1, … for counts numbers, one run after another."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - (ends - counts), counts)


def _texts(part: pa.Table) -> tuple[np.ndarray, np.ndarray, pa.Table]:
    part = part.sort_by("idx")
    data, offsets = flat(part.column("text"))
    return data, offsets, part


def without_repeats(
    docs: DataFrame, length: int = THRESHOLD, anchor: int = ANCHOR, text: str = "text", part_bytes: int = PART_BYTES
) -> DataFrame:
    """``rest`` (all columns but the text), n_bytes, n_removed, n_spans, kept: texts without repeated bytes.

    A byte goes if a ``length``-byte string over it also starts anywhere else, in this text or another;
    strings do not cross texts, all count as they were in the input, and every copy goes. ``kept`` is
    binary, as a cut may split a character.

    No suffix is sorted: grouping by hash replaces a depth-limited radix sort of suffixes, which would move a row for
    every byte in each pass. Windows are grouped by their anchor (``digit``), then by the whole span of windows around the
    anchor, then by the window itself, and groups of one are dropped. Windows of one anchor are dealt as one row, so the first
    pass moves a row for about every 70 bytes, and the second only what the first left open:

    1. spans are grouped by anchor. An anchor found once has no repeated window; equal spans
       are repeated in all their windows. Copies within a part collapse before that shuffle;
    2. where spans with one anchor differ, one of each distinct span is cut into its windows, and
       these are grouped by anchor and window.

    Anchors, spans and windows are compared by 64-bit hashes, two of which must agree; no bytes are compared. Texts are written once, cut into
    parts of ``part_bytes`` and bucketed by part; every later step reads a part where it lies, and only
    digits and positions are shuffled. A null text is empty; texts shorter than ``length`` stay whole;
    an empty table gives no rows; rows repeated in full are repeats of each other.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")]
    rows = docs.select(F.col(text).cast("string").alias("text"), F.struct(*others).alias("rest"))
    rest = rows.schema["rest"].dataType.simpleString()

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size, idx = TaskContext.get().partitionId() << 16, 0, 0
        for batch in batches:
            _, offsets = flat(batch.column("text"))
            parts, places = [], []
            for n in np.diff(offsets).tolist():
                if idx and (size + n > part_bytes or idx == PART_ROWS):
                    part, size, idx = part + 1, 0, 0
                parts.append(part)
                places.append(idx)
                size, idx = size + n, idx + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(parts, pa.int64()), pa.array(places, pa.int32()), *batch.columns], names=["part", "idx", "text", "rest"]
            )

    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (8 * part_bytes)))
    name = f"repeats_{uuid.uuid4().hex}"
    parted = rows.mapInArrow(dealt, f"part long, idx int, text string, rest {rest}")
    writer = parted.write.format("parquet").bucketBy(buckets, "part").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "parts")).saveAsTable(name)
    table = spark.table(name)

    # Pass 1: spans by anchor.
    def found(part: pa.Table) -> pa.Table:
        data, offsets, part = _texts(part)
        start, n, digit, span = _all_spans(data, offsets, length, anchor)
        here, one = _repeated_here(digit, span)
        local = here[one].astype(np.int32) + 1
        start, n, digit, span = start[one], n[one], digit[one], span[one]
        return pa.table(
            {
                "digit": digit.view(np.int64), "span": span.view(np.int64), "part": np.full(len(n), part["part"][0].as_py() if part.num_rows else 0),
                "start": start, "n": n.astype(np.int32), "copies": local,
            }
        )

    spans_ = table.select("part", "idx", "text").groupBy("part").applyInArrow(
        found, "digit long, span long, part long, start long, n int, copies int"
    )
    by_digit, by_span = Window.partitionBy("digit"), Window.partitionBy("digit", "span")
    counted = (
        spans_.withColumn("same", F.sum("copies").over(by_span))
        .withColumn("nth", F.row_number().over(by_span.orderBy("part", "start")))
        .withColumn("all", F.sum("copies").over(by_digit))
        .where("all > 1")
    )
    hits = staged(counted.select("digit", "span", "part", "start", "n", "same", "nth", (F.col("all") > F.col("same")).alias("mixed")), "spans")

    # Pass 2: windows of spans that differ under one anchor.
    def cut(part: pa.Table, asked: pa.Table) -> pa.Table:
        data, _, part = _texts(part)
        asked = asked.sort_by("start")
        start, n = (asked.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
        at = _runs(start, n)
        return pa.table(
            {
                "digit": np.repeat(asked.column("digit").to_numpy(), n),
                "window": _hash_windows(data, at, length).view(np.int64),
                "part": np.full(len(at), part["part"][0].as_py() if part.num_rows else 0),
                # A span that is repeated as a whole stands for all its copies.
                "start": at,
                "copies": np.repeat(np.minimum(asked.column("same").to_numpy(), 2).astype(np.int32), n),
            }
        )

    asked = hits.where("mixed AND nth = 1").select("part", "start", "n", "digit", "same")
    windows = table.select("part", "idx", "text").groupBy("part").cogroup(asked.groupBy("part")).applyInArrow(
        cut, "digit long, window long, part long, start long, copies int"
    )
    by_window = Window.partitionBy("digit", "window")
    again = windows.withColumn("n", F.sum("copies").over(by_window)).where("n > 1 AND copies = 1")
    covered = again.select("part", "start", F.lit(1).alias("n")).unionByName(hits.where("same > 1").select("part", "start", "n"))
    covered = staged(covered, "covered")

    def removed(part: pa.Table, covered: pa.Table) -> pa.Table:
        data, offsets, part = _texts(part)
        steps = np.zeros(len(data) + 1, np.int32)
        start, n = (covered.column(c).to_numpy().astype(np.int64) for c in ("start", "n"))
        # Spans that this part repeats by itself reached the first pass as one.
        own = _all_spans(data, offsets, length, anchor)
        here, _ = _repeated_here(own[2], own[3])
        start, n = np.concatenate([start, own[0][here]]), np.concatenate([n, own[1][here]])
        np.add.at(steps, start, 1)
        np.add.at(steps, start + n - 1 + length, -1)
        gone = np.cumsum(steps[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(gone)])
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        edges = offsets[:-1][offsets[:-1] < len(data)]
        begins[edges] = gone[edges]
        runs = np.concatenate([[0], np.cumsum(begins)])
        kept_offsets = (offsets - upto[offsets]).astype(np.int64)
        kept = pa.Array.from_buffers(
            pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(kept_offsets.tobytes()), pa.py_buffer(data[~gone].tobytes())]
        )
        return pa.table(
            {
                "rest": part.column("rest"), "n_bytes": np.diff(offsets), "n_removed": np.diff(upto[offsets]),
                "n_spans": np.diff(runs[offsets]), "kept": kept.cast(pa.binary()),
            }
        )

    return table.groupBy("part").cogroup(covered.groupBy("part")).applyInArrow(
        removed, f"rest {rest}, n_bytes long, n_removed long, n_spans long, kept binary"
    )
