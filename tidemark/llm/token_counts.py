"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, groups_of_bytes, owners, per_text
from tidemark.llm.pieces import encoder
from tidemark.llm.staging import let_workers_import

LIMIT = 2048
#: Text encoded together.
BATCH_BYTES = 1 << 20


def token_lengths(path: str):
    """A column function: tokens of a text under the tokenizer file ``path``, none for null."""

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with_counts = encoder(path, keep_ids=False)
        for texts in batches:
            data, offsets = flat(texts)
            out = np.zeros(len(texts), np.int64)
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts, ends = with_counts.cut(part, edges)
                places = with_counts.places(part, starts, ends)
                out[i:j] = per_text(with_counts.counts[places], owners(edges, starts), j - i)
            yield pa.array(out)

    return lengths


def counted(docs: DataFrame, path: str, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """The rows with ``n_bytes``, ``n_tokens``, ``over_limit``; these replace columns of those names.

    Whole texts are counted, as the tokenizers library encodes them without added special tokens;
    special strings inside a text count as its default has it. Within an Arrow batch the texts are
    encoded in lots of about BATCH_BYTES, cut at safe boundaries into pieces, so that a long text
    needs no long call, and only lengths come back. A null or empty text has 0 tokens. No row moves
    between tasks.
    """
    let_workers_import(docs.sparkSession)
    lengths = token_lengths(path)
    return docs.withColumns(
        {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"), "n_tokens": lengths(F.col(text))}
    ).withColumn("over_limit", F.col("n_tokens") > limit)
