"""Each operator over one text beyond an Arrow batch, a lot and a part, beside short ones."""

import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, minhash, mixing, pieces, quality, repeats, sharding, token_counts, token_files, url_rules
from tidemark.session import scratch_path

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SENTENCE = "the quick brown fox number {} jumps over the lazy dog while rivers of question marks ask who comes first "
LONG = "".join(SENTENCE.format(i * 7919 % 100_003) for i in range(90_000))  # 9.5 MB
ITEM = "A passage of a test: which of the three mountains was climbed before the war by the two sisters? The Matterhorn."


@pytest.fixture(scope="module")
def docs(spark):
    texts = [LONG + ITEM, "a short text of seven words here", LONG + ITEM, ITEM, None]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_counts_and_files(spark, docs):
    want = {i: len(pieces.load(TOKENIZER).encode(t or "", add_special_tokens=False).ids) for i, t in ((0, LONG + ITEM), (3, ITEM), (4, None))}
    got = {r.doc_id: r.n_tokens for r in token_counts.counted(docs, TOKENIZER).collect()}
    assert {i: got[i] for i in want} == want and got[2] == got[0]
    path = scratch_path(spark, "long")
    token_files.write_token_files(docs, path, TOKENIZER, file_bytes=4 << 20)
    back = {r.doc_id: r for r in token_files.read_documents(spark, path).collect()}
    assert {i: back[i].n_tokens for i in got} == {i: n + 1 for i, n in got.items()} and back[0].ids_crc32 == back[2].ids_crc32


def test_whole_texts_are_judged(spark, docs):
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert classes == {0: 0, 1: 1, 2: 0, 3: 3, 4: 4}
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    found = decontaminate.leaks(docs, decontaminate.question_and_answer(items))
    assert sorted(r.doc_id for r in found.collect()) == [0, 2, 3]
    counts = {r.doc_id: r for r in quality.measured(docs).drop("text").collect()}
    assert counts[0].n_words == len((LONG + ITEM).split()) and counts[3].n_words == len(ITEM.split())
    rests = {r.rest.doc_id: (r.n_removed, len(r.kept)) for r in repeats.without_repeats(docs).collect()}
    assert rests[0] == rests[2] == (len(LONG + ITEM), 0) and rests[1][0] == 0


def test_rows_stay_whole(spark, docs):
    placed = sharding.shuffled_shards(docs, shards=2).select("record.doc_id", F.crc32(F.col("record.text").cast("binary")).alias("crc"))
    assert {r.doc_id: r.crc for r in placed.collect()}[0] == zlib.crc32((LONG + ITEM).encode())
    mix = {r.record.doc_id: r["size"] for r in mixing.mixed(docs).collect()}
    assert mix[0] == len((LONG + ITEM).split()) and len(mix) == 5
    urls = spark.createDataFrame([(1, "http://a.net/" + "x" * 3_000_000), (2, "http://b.org/fr/")], "page_id long, url string")
    assert {r.page_id: r.rule for r in url_rules.judged(urls).collect()} == {1: "net/", 2: "org/fr/"}
