"""From raw documents to token files: quality, near-dedup, decontamination, mixing, output.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``docs``, unchanged. A stage works on
all its predecessor kept; null and empty texts, repeated rows, empty tables and further columns are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, quality, token_files
from tidemark.llm.queries import table, tokenizer_path
from tidemark.llm.staging import staged
from tidemark.session import scratch_path

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the certified rules of their language."""
    record = docs.select(
        F.struct("*").alias("record"),
        F.col("doc_id").alias("doc_id"), F.col("lang").alias("lang"), F.col("text").alias("text"),
    )
    measured = quality.measured(record)
    cutoffs = quality.certified_cutoffs(staged(measured.drop("record", "text"), "counts"), table(spark, sf_dir, "labels"))
    return quality.judged(measured, cutoffs).where("kept").select("record.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest doc_id."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, decontaminate.question_and_answer(table(spark, sf_dir, "benchmark")))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each repetition, none for those left out."""
    mixed = mixing.mixed(docs)
    return mixed.where("times > 0").select("record", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("record.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: doc_id, start, n_tokens, ids_crc32 for every row."""
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(docs, path, tokenizer_path(TOKENIZER))
    return token_files.read_documents(spark, path)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixture),
    ("token_output", token_output),
]

#: SQL cannot express the stages of signatures and tokenizers; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
