"""Nulls in any column, empty and repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, lm, minhash, mixing, quality, repeats, sharding, token_counts, token_files, url_rules
from tidemark.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Names that the operators use themselves.
EXTRA = [
    "size", "draw", "record", "bucket", "place", "shard", "slot", "target", "times", "host", "rule", "n_tokens", "n_words",
    "kept", "part", "idx", "rest", "start", "row", "key", "word", "node", "text_key", "class_id", "_key", "_n", "_text_key", "none",
    "held_out", "score", "_counts", "base_failed", "_k", "_t", "_stratum", "cut", "_source", "symbols",
]
TEXTS = [None, "", " ", "\n", "one", "word " * 40, "é" * 1000, "long text with many words and a repeated tail " * 400, "the same text " * 40]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 3 else None, t, None if i % 2 else "en", ["a", None, "B"][i % 3], len(t or "")) for i, t in enumerate(TEXTS * 2)]
    rows += [(7, TEXTS[-1], "en", "a", 1)] * 5 + [(None, None, None, None, None)] * 4 + [(None, TEXTS[-1], None, None, None)] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(i) for i, c in enumerate(EXTRA)}).repartition(3)


@pytest.fixture(scope="module", params=["odd", "empty"])
def docs(request, odd):
    return odd if request.param == "odd" else odd.limit(0)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Empty side tables."""
    path = str(tmp_path_factory.mktemp("side"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(None, None, None), (7, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_sharding(docs):
    rows = sharding.shuffled_shards(docs, shards=4).collect()
    assert len(rows) == docs.count()
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_mixing(docs):
    rows = mixing.mixed(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r.times <= 3 for r in rows)


def test_url_rules(docs):
    rows = url_rules.judged(docs, url="text").collect()
    assert len(rows) == docs.count() and {r.verdict for r in rows} <= {"allow"}


def test_token_counts(docs):
    rows = token_counts.counted(docs, TOKENIZER).collect()
    assert len(rows) == docs.count() and all(r.n_tokens == 0 for r in rows if not r.text)


@pytest.mark.parametrize("layout", ["byte", "bit"])
def test_token_files(spark, docs, layout):
    path = scratch_path(spark, "odd")
    token_files.write_token_files(docs, path, TOKENIZER, layout, block_ids=300)
    rows = sorted(token_files.read_documents(spark, path).collect(), key=lambda r: r.start)
    assert len(rows) == docs.count() and all(r.n_tokens >= 1 for r in rows)
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]


def test_quality(spark, docs, sf_dir):
    counts = quality.measured(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    cutoffs = quality.certified_cutoffs(counts.drop("symbols"), labels)
    rows = quality.judged(counts, cutoffs).collect()
    assert len(rows) == docs.count() and not any(r.kept for r in rows if not r.text)


def test_near_duplicates(docs):
    rows = minhash.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    kept = minhash.deduplicated(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    full = [" ".join(t.split()) for t in texts if t and t.strip()]
    assert len(full) == len(set(full))


def test_decontamination(spark, docs, sf_dir):
    none = decontaminate.question_and_answer(spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    assert decontaminate.leaks(docs, none).count() == 0
    assert decontaminate.without_leaks(docs, none).count() == docs.count()
    items = spark.createDataFrame([(1, TEXTS[-1]), (2, None), (3, ""), (None, "word word word")], "item_id long, text string")
    found = decontaminate.leaks(docs, decontaminate.question_and_answer(items))
    assert found.where("item_id = 1").count() == docs.where(F.col("text") == TEXTS[-1]).count()


def test_repeats(docs):
    rows = repeats.without_repeats(docs).collect()
    assert len(rows) == docs.count()
    assert all(r.n_removed == r.n_bytes for r in rows if r.n_bytes == len(TEXTS[-1]))


def test_language_model(docs):
    rows = lm.scored(docs).collect()
    assert len(rows) == docs.count() and all(r.n_tokens >= 1 and r.score <= 0 for r in rows)


def test_pipeline_stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert name == "token_output" or out.columns == docs.columns
        out.count()
