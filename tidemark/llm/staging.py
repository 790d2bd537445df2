"""Written tables in the shared folder, and code the Python workers can import."""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

import tidemark
from tidemark.llm import arrays
from tidemark.session import scratch_path


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage: later jobs reread the table instead of repeating the work, and a lost
    executor costs nothing that was finished.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch, where the session does not say otherwise: rows of text differ too much to count them.
ARROW_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def let_workers_import(spark: SparkSession) -> None:
    """Let Python workers that share the driver's disk import this package, and bound the batches they get.

    On a cluster, install the package or ship it with ``--py-files``.
    """
    if _BATCH not in spark.conf.getAll:
        spark.conf.set(_BATCH, ARROW_BYTES)
    root = os.path.dirname(os.path.dirname(os.path.abspath(tidemark.__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def release() -> None:
    """Give the free memory of this process back to the system: an idle worker then holds little."""
    arrays.forget_powers()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` on a task's batches, with the worker's free memory released when the task ends."""

    @functools.wraps(work)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release()

    return run
