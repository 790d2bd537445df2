"""Benchmark decontamination: passages query a BM25 index of test items, with block-max pruning."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import WHITE, flat, groups_of_bytes, hash_words, owners, word_edges
from tidemark.llm.staging import lean, let_workers_import, staged
from tidemark.llm.windows import window_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
SCORE = 0.6
#: Shares of the question's five-word shingles and of the answer's words that the passage must hold.
QUESTION, ANSWER = 0.8, 0.8
SHINGLE = 5
#: Items in a block of the index, and text of items that one index (and broadcast) holds.
BLOCK_ITEMS = 32
INDEX_BYTES = 16 << 20
BATCH_BYTES = 1 << 20

# Words are compared without case and punctuation, of ASCII letters and signs.
_PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_BLANK = WHITE.copy()
_BLANK[list(_PUNCTUATION)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word."""
    data = _LOWER[data]
    starts, ends = word_edges(data, offsets, _BLANK)
    return hash_words(data, starts, ends), owners(offsets, starts)


def shingles(words: np.ndarray) -> tuple[int, np.ndarray]:
    """Words of a shingle and the distinct shingles; fewer than five words are one shingle."""
    size = min(SHINGLE, len(words))
    return size, np.unique(window_hashes(words, size)) if size else words


@dataclass
class Index:
    """Postings by term, their maxima by block of items, and what verification needs.

    An impact is the BM25 weight of a term in an item, divided by the item's score for its own text,
    so that a passage with all of an item's words scores 1.
    """

    ids: list
    terms: np.ndarray
    bound: np.ndarray  # highest impact of a term
    first: np.ndarray  # postings of term t: first[t] to first[t + 1]
    items: np.ndarray
    impacts: np.ndarray
    block_first: np.ndarray  # the same for (block, highest impact in it)
    blocks: np.ndarray
    block_impacts: np.ndarray
    questions: list[tuple[int, np.ndarray]]
    answers: list[tuple[np.ndarray, np.ndarray]]
    width: int  # words of a passage


def build_index(rows: list, documents: dict[int, int], total: int, mean_words: float) -> Index:
    """The index of ``rows`` (item_id, question, answer).

    ``documents``: items that hold a term, by its hash; ``total`` and ``mean_words``: number and
    mean length of items, over all blocks of items.
    """
    term, item, frequency, lengths, questions, answers = [], [], [], [], [], []
    for i, row in enumerate(rows):
        parts = [words_of(*flat(pa.array([t or ""])))[0] for t in (row["question"], row["answer"])]
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        term.append(found)
        item.append(np.full(len(found), i))
        frequency.append(n)
        lengths.append(max(1, int(n.sum())))
        questions.append(shingles(parts[0]))
        answers.append(np.unique(parts[1], return_counts=True))
    term, item, frequency = np.concatenate(term), np.concatenate(item), np.concatenate(frequency)
    length = np.array(lengths)
    terms, at = np.unique(term, return_inverse=True)
    holders = np.array([documents[int(t)] for t in terms], float)
    weight = np.log1p((total - holders + 0.5) / (holders + 0.5))
    impact = weight[at] * frequency * (K1 + 1) / (frequency + K1 * (1 - B + B * length[item] / mean_words))
    impact /= np.bincount(item, impact, len(rows))[item]

    order = np.lexsort((item, at))
    at, item, impact = at[order], item[order], impact[order]
    first = np.searchsorted(at, np.arange(len(terms) + 1))
    block = item // BLOCK_ITEMS
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (block[1:] != block[:-1])])) if len(at) else at
    block_impacts = np.maximum.reduceat(impact, new) if len(new) else impact
    block_first = np.searchsorted(at[new], np.arange(len(terms) + 1))
    bound = np.maximum.reduceat(impact, first[:-1]) if len(terms) else impact
    return Index(
        [r["item_id"] for r in rows], terms, bound, first, item, impact, block_first, block[new], block_impacts,
        questions, answers, 2 * int(length.max(initial=1)),
    )


def _expand(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each term the places first[t]..first[t+1]; and which entry of ``terms`` each belongs to."""
    counts = first[terms + 1] - first[terms]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(np.arange(len(terms)), counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(first[terms], counts), source


def _sums(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at, values, len(found))


def matches(index: Index, data: np.ndarray, offsets: np.ndarray, least: float = SCORE) -> Iterator[tuple]:
    """(text, item, score, question share, answer share) of every verified pair in a flat batch.

    Passages are ``width`` words long and begin every half of that, so that an item that a text holds
    lies within one. All passages of the batch go through WAND's bounds together: the sum of the
    terms' highest impacts, then the sum of their highest impacts in a block of items, and only
    blocks that can reach ``least`` are scored. Every passage and item above it is then verified.
    """
    words, owner = words_of(data, offsets)
    if not len(words) or not len(index.terms):
        return
    n_texts = len(offsets) - 1
    per_text = np.bincount(owner, minlength=n_texts)
    text_first = np.cumsum(per_text) - per_text
    step = index.width // 2
    # Half passages are numbered through the batch; passage h is the halves h and h + 1 of one text.
    halves = -(-per_text // step)
    half_first = np.cumsum(halves) - halves
    half = half_first[owner] + (np.arange(len(words)) - text_first[owner]) // step
    half_owner = np.repeat(np.arange(n_texts), halves)

    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[at] == words)
    term, half = at[known], half[known]
    total = np.bincount(half, index.bound[term], len(half_owner))
    following = np.append(half_owner[1:] == half_owner[:-1], False) if len(half_owner) else half_owner
    # Repeated words count again here: still an upper bound, and it needs no sorting.
    likely = total + np.where(following, np.append(total[1:], 0), 0) >= least
    if not likely.any():
        return
    wide = len(index.terms)
    pairs = [(half * wide + term)[likely[half]]]
    before = half - 1
    ok = (before >= 0) & (half > 0)
    ok[ok] = following[before[ok]] & likely[before[ok]]
    pairs.append((before * wide + term)[ok])
    pairs = np.unique(np.concatenate(pairs))
    passage, term = pairs // wide, pairs % wide
    found, bound = _sums(passage, index.bound[term])
    keep = np.isin(passage, found[bound >= least])
    passage, term = passage[keep], term[keep]

    n_blocks = len(index.ids) // BLOCK_ITEMS + 1
    place, source = _expand(index.block_first, term)
    found, bound = _sums(passage[source] * n_blocks + index.blocks[place], index.block_impacts[place])
    open_ = found[bound >= least]
    place, source = _expand(index.first, term)
    inside = np.isin(passage[source] * n_blocks + index.items[place] // BLOCK_ITEMS, open_)
    place, source = place[inside], source[inside]
    n_items = len(index.ids)
    found, score = _sums(passage[source] * n_items + index.items[place], index.impacts[place])
    hit = score >= least - 1e-9

    best: dict[tuple[int, int], tuple] = {}
    for pair, value in zip(found[hit].tolist(), score[hit].tolist()):
        p, item = divmod(pair, n_items)
        text = int(half_owner[p])
        # The words of the passage, and those of the item that they hold.
        start = int(text_first[text] + (p - half_first[text]) * step)
        held = words[start : min(start + index.width, int(text_first[text] + per_text[text]))]
        size, own = index.questions[item]
        q = float(np.isin(own, window_hashes(held, size)).mean()) if len(own) else 1.0
        answer, times = index.answers[item]
        a = 1.0
        if len(answer):
            spots = np.minimum(np.searchsorted(answer, held), len(answer) - 1)
            have = np.bincount(spots[answer[spots] == held], minlength=len(answer))
            a = float(np.minimum(have, times).sum() / times.sum())
        if q >= QUESTION and a >= ANSWER:
            best[text, item] = max(best.get((text, item), (0.0,)), (value, q, a))
    for (text, item), (value, q, a) in sorted(best.items()):
        yield text, item, value, q, a


def question_and_answer(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, question, answer: the last sentence of an item's text is its answer, if it has more than one."""
    split = r"(?s)^(.*[.!?])\s+(\S.*)$"
    whole = F.coalesce(F.col(text), F.lit(""))
    question = F.regexp_extract(whole, split, 1)
    return benchmark.select(
        F.col(item).alias("item_id"),
        F.when(question == "", whole).otherwise(question).alias("question"),
        F.regexp_extract(whole, split, 2).alias("answer"),
    )


def indexes(items: DataFrame, index_bytes: int = INDEX_BYTES) -> Iterator[Index]:
    """An index for each block of items (item_id, question, answer) of about ``index_bytes``.

    How many items hold a term, and items' mean length, are counted by Spark over all items; a block
    brings its own items and terms to the driver, which its size bounds. Items without words are left out.
    """
    spark = items.sparkSession
    let_workers_import(spark)

    @lean
    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            both = pa.concat_arrays([batch.column(c).cast(pa.large_string()) for c in ("question", "answer")])
            words, owner = words_of(*flat(both))
            owner = owner % n if n else owner
            lengths = np.bincount(owner, minlength=n)
            order = np.lexsort((words, owner))
            words, owner = words[order], owner[order]
            new = np.ones(len(words), bool)
            new[1:] = (words[1:] != words[:-1]) | (owner[1:] != owner[:-1])
            held = np.split(words[new].view(np.int64), np.searchsorted(owner[new], np.arange(1, n))) if n else []
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("item_id", "question", "answer")], pa.array(lengths, pa.int64()),
                 pa.array(held, pa.list_(pa.int64()))],
                names=["item_id", "question", "answer", "n_words", "terms"],
            )

    size = F.coalesce(F.octet_length("question"), F.lit(0)) + F.coalesce(F.octet_length("answer"), F.lit(0))
    schema = "item_id long, question string, answer string, n_words long, terms array<long>"
    known = items.select(F.col("item_id").cast("long").alias("item_id"), "question", "answer").mapInArrow(terms, schema)
    known = staged(known.where("n_words > 0"), "items")
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.avg("n_words").alias("mean"), F.sum(size).alias("bytes")).first()
    blocks = max(1, math.ceil((totals["bytes"] or 0) / index_bytes))
    block = F.pmod(F.xxhash64("item_id", "question", "answer"), F.lit(blocks))
    holders = staged(known.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n")), "terms")
    for b in range(blocks if totals["n"] else 0):
        own = known.where(block == b)
        needed = own.select(F.explode("terms").alias("term")).distinct().join(holders, "term")
        documents = {r["term"] & (1 << 64) - 1: r["n"] for r in needed.toLocalIterator()}
        rows = own.select("item_id", "question", "answer").orderBy("item_id", "question", "answer").collect()
        if rows:
            yield build_index(rows, documents, totals["n"], totals["mean"])


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, item_id, score, question_overlap, answer_overlap: every document and test item found in it.

    The query set is every passage of every document. The items' index is broadcast in blocks of
    bounded size, with one pass over the documents for each block; documents don't move. A pair is reported once, with
    its best passage. A very long text is read whole, passage by passage. Null and empty texts hold nothing; an empty table on either side gives no rows;
    rows with one key are judged each on its own; equal items are each reported.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        @lean
        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = flat(batch.column("text"))
                keys = batch.column("doc_id")
                for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                    part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    pairs = list(matches(shared.value, *part))
                    columns = list(zip(*pairs)) if pairs else [()] * 5
                    yield pa.RecordBatch.from_arrays(
                        [
                            keys.take(pa.array([i + t for t in columns[0]], pa.int64())),
                            pa.array([shared.value.ids[n] for n in columns[1]], pa.int64()),
                            *[pa.array(c, pa.float64()) for c in columns[2:]],
                        ],
                        names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"],
                    )

        out = out.unionByName(rows.mapInArrow(found, schema))
    return out.withColumnRenamed("doc_id", key)


def _leaking(shared: Broadcast):
    """A column function: whether a text holds an item of the broadcast index."""

    @F.arrow_udf("boolean")
    @lean
    def leaking(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = flat(texts)
            out = np.zeros(len(texts), bool)
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                part = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                out[[i + pair[0] for pair in matches(shared.value, *part)]] = True
            yield pa.array(out)

    return leaking


def without_leaks(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text holds no test item, unchanged; see ``leaks``."""
    let_workers_import(docs.sparkSession)
    for index in indexes(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = docs.where(~_leaking(shared)(F.col(text)))
    return docs
