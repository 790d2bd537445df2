"""Token-id files: bit- or byte-plane blocks, compressed plane by plane, with a chunk index."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, groups_of_bytes, owners
from tidemark.llm.pieces import encoder, forget_encoder
from tidemark.llm.staging import lean, let_workers_import, staged

#: Ids in a block, text in a file on average, text encoded together.
BLOCK_IDS = 1 << 16
FILE_BYTES = 64 << 20
#: Bytes of blocks that a writer gathers and a reader decodes together.
GROUP_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
LEVEL = 1
END = 0

_DOCS = "array<struct<doc:long,doc_id:long,start:int,n:int,before:long>>"
#: One row is one block. ``planes`` are zstandard frames; all else is the chunk index: where the block
#: stands in its file, and which documents' ids it holds (``before`` are the document's ids in earlier blocks).
SCHEMA = f"file int, block long, first long, n_ids int, layout string, docs {_DOCS}, planes array<binary>"


def to_planes(ids: np.ndarray, layout: str) -> list[bytes]:
    """The ids as four byte planes or 32 bit planes, lowest first."""
    columns = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if layout == "byte":
        return [np.ascontiguousarray(columns[:, i]).tobytes() for i in range(4)]
    bits = np.unpackbits(columns, axis=1, bitorder="little")
    return [np.packbits(np.ascontiguousarray(bits[:, i])).tobytes() for i in range(32)]


def from_planes(planes: list[bytes], n: int, layout: str) -> np.ndarray:
    """The ids of ``to_planes``."""
    if layout == "byte":
        columns = np.empty((n, 4), np.uint8)
        for i, plane in enumerate(planes):
            columns[:, i] = np.frombuffer(plane, np.uint8)
    else:
        bits = np.empty((n, 32), np.uint8)
        for i, plane in enumerate(planes):
            bits[:, i] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n)
        columns = np.packbits(bits, axis=1, bitorder="little")
    return columns.reshape(-1).view("<u4")


def _with_ends(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents' ids in a row, each followed by the end id, and their new counts."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, layout: str = "byte", block_ids: int = BLOCK_IDS,
    file_bytes: int = FILE_BYTES, end: int = END, text: str = "text", key: str = "doc_id",
) -> None:
    """Write the ids of all texts under ``path`` in ascending ``key`` order, rows without a key first.

    A file is one range of keys; within it, ids run on from document to document, each with ``end``
    after it, and are cut into blocks of ``block_ids``. A block is split into ``byte`` or ``bit`` planes
    and each plane is compressed on its own. Equal keys stand in the order of their texts' hashes. Spark's
    Parquet writer holds the blocks, so a lost task is written again and leaves nothing behind, on any
    store. A null or empty text has the end id alone; an empty table gives no block. The task
    holds one Arrow batch and one block; a longer text is held whole.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = rows.repartitionByRange(max(1, math.ceil(total / file_bytes)), *order).sortWithinPartitions(*order)

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer = encoder(tokenizer, keep_ids=True), zstandard.ZstdCompressor(level=LEVEL)
        file = TaskContext.get().partitionId()
        waiting, held, inside = [], 0, []  # ids and documents of the block at hand
        block = first = doc = 0

        def close(n: int) -> pa.RecordBatch:
            nonlocal waiting, held, inside, block, first
            ids = np.concatenate(waiting)
            row = {
                "file": file, "block": block, "first": first, "n_ids": n, "layout": layout, "docs": inside,
                "planes": [packer.compress(p) for p in to_planes(ids[:n], layout)],
            }
            waiting, held, inside, block, first = [ids[n:]], held - n, [], block + 1, first + n
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            data, offsets = flat(batch.column("text"))
            keys = batch.column("doc_id").to_pylist()
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends = pieces.cut(part, edges)
                places = pieces.places(part, starts, ends)
                counts = np.bincount(owners(edges, starts), pieces.counts[places], j - i).astype(np.int64)
                ids, counts = _with_ends(pieces.ids_of(places), counts, end)
                at = 0
                for d, n in zip(keys[i:j], counts.tolist()):
                    left, before = n, 0
                    while left:
                        take = min(left, block_ids - held)
                        waiting.append(ids[at : at + take])
                        inside.append({"doc": doc, "doc_id": d, "start": held, "n": take, "before": before})
                        at, left, before, held = at + take, left - take, before + take, held + take
                        if held == block_ids:
                            yield close(held)
                    doc += 1
        if held:
            yield close(held)
        forget_encoder()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(SCHEMA))
    # The planes are compressed already.
    written = ranged.mapInArrow(blocks, SCHEMA).write
    written.option("compression", "none").option("parquet.block.size", GROUP_BYTES).parquet(path)


def _times(a: int, b: int) -> int:
    """Product of two polynomials over bits, modulo the CRC-32 polynomial (bits reversed)."""
    out = 0
    for i in range(31, -1, -1):
        if a >> i & 1:
            out ^= b
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return out


def joined_crc(left: int, right: int, right_bytes: int) -> int:
    """CRC-32 of two byte strings in a row, from the CRC-32 of each."""
    power, square, n = 1 << 31, 1 << 23, right_bytes  # 1 and x**8
    while n:
        if n & 1:
            power = _times(square, power)
        square, n = _times(square, square), n >> 1
    return _times(power, left) ^ right


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files under ``path``.

    Each block is decoded by itself; a document that runs over several blocks is put together from
    its parts' lengths and checksums, so that no task holds more than a block.
    """
    let_workers_import(spark)
    table = spark.read.schema(SCHEMA).parquet(path)

    @lean
    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in range(batch.num_rows):
                one = batch.slice(row, 1).to_pylist()[0]
                ids = from_planes([unpacker.decompress(p) for p in one["planes"]], one["n_ids"], one["layout"])
                raw = memoryview(ids.tobytes())
                docs = one["docs"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([one["file"]] * len(docs), pa.int32()),
                        pa.array([d["doc"] for d in docs], pa.int64()),
                        pa.array([d["doc_id"] for d in docs], pa.int64()),
                        pa.array([one["first"] + d["start"] for d in docs], pa.int64()),
                        pa.array([d["before"] for d in docs], pa.int64()),
                        pa.array([d["n"] for d in docs], pa.int64()),
                        pa.array([zlib.crc32(raw[4 * d["start"] : 4 * (d["start"] + d["n"])]) for d in docs], pa.int64()),
                    ],
                    names=["file", "doc", "doc_id", "place", "before", "n", "crc"],
                )

    @F.pandas_udf("long")
    def all_crc(lists: pd.Series) -> pd.Series:
        out = []
        for found in lists:
            crc = None
            for part in found if found is not None else ():
                crc = part["crc"] if crc is None else joined_crc(crc, part["crc"], 4 * part["n"])
            out.append(crc)
        return pd.Series(out, dtype="Int64")

    read = table.mapInArrow(parts, "file int, doc long, doc_id long, place long, before long, n long, crc long")
    documents = read.groupBy("file", "doc").agg(
        F.first("doc_id").alias("doc_id"),
        F.min("place").alias("place"),
        F.sum("n").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("before", "n", "crc"))).alias("parts"),
    )
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = staged(
        table.groupBy("file")
        .agg(F.sum("n_ids").alias("ids"))
        .select(F.col("file").alias("_file"), F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("offset")),
        "files",
    )
    several = F.size("parts") > 1
    return documents.join(files, F.col("file") == F.col("_file")).select(
        "doc_id",
        (F.col("offset") + F.col("place")).alias("start"),
        "n_tokens",
        F.coalesce(all_crc(F.when(several, F.col("parts"))), F.col("parts")[0]["crc"]).alias("ids_crc32"),
    )
