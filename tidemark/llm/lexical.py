"""Ranked lexical search: documents of one bag of item words are scored once, as a class."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, groups_of_bytes, hash_words, owners, word_edges
from tidemark.llm.staging import let_workers_import, staged

BEST = 50
#: Text of items in one index, which bounds what a broadcast holds; text worked on together; cells of a score table.
INDEX_BYTES = 16 << 20
BATCH_BYTES = 1 << 20
CELLS = 1 << 21
#: A row without a key comes before all others.
NO_KEY = -(1 << 63)

_BYTES = np.arange(256)
_LETTERS = ((_BYTES >= 65) & (_BYTES <= 90)) | ((_BYTES >= 97) & (_BYTES <= 122))
#: Bytes that stand in no term: ASCII that is neither letter nor digit.
_BLANK = (_BYTES < 128) & ~_LETTERS & ~((_BYTES >= 48) & (_BYTES <= 57))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of ranges in a row."""
    jump = starts - (np.cumsum(sizes) - sizes)
    return data[np.arange(int(sizes.sum())) + np.repeat(jump, sizes)]


@dataclass
class Index:
    """Terms of a block of items, by hash and bytes, and the items that hold each."""

    ids: list
    hashes: np.ndarray  # ascending; terms may share one
    text: np.ndarray
    edges: np.ndarray  # bytes of term t: text[edges[t] : edges[t + 1]]
    first: np.ndarray  # items of term t: items[first[t] : first[t + 1]]
    items: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The term of each word, compared byte by byte, or -1."""
        out = np.full(len(starts), -1, np.int64)
        if not len(self.hashes):
            return out
        words = hash_words(data, starts, ends)
        at = np.searchsorted(self.hashes, words)
        left = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == words)
        while len(left):
            term, size = at[left], (ends - starts)[left]
            fits = np.flatnonzero(np.diff(self.edges)[term] == size)
            term, size, word = term[fits], size[fits], left[fits]
            unlike = _gather(self.text, self.edges[term], size) != _gather(data, starts[word], size)
            same = np.add.reduceat(unlike, np.cumsum(size) - size, dtype=np.int64) == 0 if len(size) else size == 0
            out[word[same]] = term[same]
            left = left[out[left] < 0]
            at[left] += 1
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == words[left]]
        return out


def build_index(rows: list) -> Index:
    """The index of ``rows`` (item_id, text); weights come later, from the documents."""
    held: dict[bytes, list[int]] = {}
    for i, row in enumerate(rows):
        data, offsets = flat(pa.array([row["text"] or ""]))
        data = _LOWER[data]
        raw = data.tobytes()
        for term in {raw[s:e] for s, e in zip(*(x.tolist() for x in word_edges(data, offsets, _BLANK)))}:
            held.setdefault(term, []).append(i)
    terms = sorted(held)
    text = np.frombuffer(b"".join(terms), np.uint8)
    sizes = np.array([len(t) for t in terms], np.int64)
    edges = np.append(0, np.cumsum(sizes))
    hashes = hash_words(text, edges[:-1], edges[1:])
    order = np.argsort(hashes, kind="stable")
    posting = [held[terms[t]] for t in order.tolist()]
    return Index(
        [r["item_id"] for r in rows], hashes[order], _gather(text, edges[:-1][order], sizes[order]),
        np.append(0, np.cumsum(sizes[order])), np.append(0, np.cumsum([len(p) for p in posting])).astype(np.int64),
        np.array([i for p in posting for i in p], np.int64),
    )


def bags(index: Index, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Terms of each text of a flat batch, and its bag: (term of the index, times) as int32 pairs by term."""
    n = len(offsets) - 1
    data = _LOWER[data]
    starts, ends = word_edges(data, offsets, _BLANK)
    owner = owners(offsets, starts)
    term = index.places(data, starts, ends)
    known = term >= 0
    wide = max(1, len(index.hashes))
    pairs, times = np.unique(owner[known] * wide + term[known], return_counts=True)
    both = np.column_stack([pairs % wide, times]).astype("<i4")
    edge = np.searchsorted(pairs, np.arange(n + 1) * wide)
    raw = both.tobytes()
    return np.bincount(owner, minlength=n), [raw[8 * s : 8 * e] for s, e in zip(edge[:-1].tolist(), edge[1:].tolist())]


def best_of(item: np.ndarray, score: np.ndarray, first: np.ndarray, best: int) -> np.ndarray:
    """Places of each item's ``best`` highest scores, equal ones by ``first``."""
    order = np.lexsort((first, -score, item))
    sorted_item = item[order]
    begin = np.searchsorted(sorted_item, sorted_item)
    return order[np.arange(len(order)) - begin < best]


def scores(index: Index, bag: list[bytes], m: np.ndarray) -> np.ndarray:
    """(classes, items): the score of every class for every item."""
    n_items = len(index.ids)
    sizes = np.array([len(b) // 8 for b in bag], np.int64)
    pairs = np.frombuffer(b"".join(bag), "<i4").reshape(-1, 2).astype(np.int64)
    of = np.repeat(np.arange(len(bag)), sizes)
    term, tf = pairs[:, 0], pairs[:, 1]
    impact = index.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[of]))
    count = index.first[term + 1] - index.first[term]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) + np.repeat(index.first[term] - (ends - count), count)
    out = np.zeros(len(bag) * n_items, np.int64)
    np.add.at(out, np.repeat(of * n_items, count) + index.items[place], np.repeat(impact, count))
    return out.reshape(len(bag), n_items)


def bag_digest(bag: Column, m: Column) -> Column:
    """128 bits of a bag and its length norm."""
    return F.unhex(F.md5(F.concat(bag, F.encode(F.concat(F.lit(":"), m.cast("string")), "UTF-8"))))


def ranked(
    docs: DataFrame, items: DataFrame, best: int = BEST, text: str = "text", key: str = "doc_id", item_text: str = "text",
    item: str = "item_id", index_bytes: int = INDEX_BYTES, digest: Callable[[Column, Column], Column] = bag_digest,
) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``best`` documents of score above 0, equal scores by ascending ``key``.

    Terms are runs of ASCII letters and digits and of all else beyond ASCII, A-Z in lower case, in whole texts.
    A document counts by its bag (the item terms it holds, with their counts) and its length norm m alone, so
    equal pairs form a class: found by a digest, verified by comparing the bags themselves, scored once. An item's best ``best`` classes,
    equal scores by their smallest key, hold its best documents; those are opened into their ``best`` smallest keys each.
    If two bags ever share a digest, bags take its place as keys.

    Items go into indexes of ``index_bytes`` of text, which bounds the broadcast; each index takes one pass over
    the documents. Counts (N, L, document frequencies) are over all documents. No task holds more
    than an Arrow batch, a score table of bounded size and ``best`` rows for each item.

    A null text has no terms; a document or item without terms is in no row. Rows equal in key are documents (or items) of their own; rows
    without a key come first among equals. An empty table on either side gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_KEY)).alias("doc_id"), F.col(text).alias("text"))
    wanted = items.select(F.col(item).cast("long").alias("item_id"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    wanted = staged(wanted, "items")
    blocks = max(1, math.ceil((wanted.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / index_bytes))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in range(blocks):
        held = wanted.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).orderBy("item_id", "text").collect()
        if held:
            out = out.unionByName(_ranked(rows, build_index(held), best, digest))
    return out


def _ranked(rows: DataFrame, index: Index, best: int, digest: Callable[[Column, Column], Column]) -> DataFrame:
    """``ranked`` for the items of one index."""
    context = rows.sparkSession.sparkContext
    vocabulary = context.broadcast(index)

    def bagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                n, found = bags(vocabulary.value, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.array(n, pa.int64()), pa.array(found, pa.binary())],
                    names=["doc_id", "n", "bag"],
                )

    def holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(vocabulary.value.hashes), np.int64)
        for batch in batches:
            data, _ = flat(batch.column("bag"))
            count += np.bincount(data.view("<i4")[::2], minlength=len(count))
        term = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(count[term])], names=["term", "df"])

    found = staged(rows.mapInArrow(bagged, "doc_id long, n long, bag binary"), "bags")
    totals = found.agg(F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"]
    frequency = np.zeros(len(index.hashes), np.int64)
    sums = found.select("bag").mapInArrow(holders, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    for row in sums.collect():  # a row for each term of the index, whose size is bounded
        frequency[row["term"]] = row["df"]
    index.weights = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * frequency + 1))).astype(np.int64)
    weighted = context.broadcast(index)

    norm = F.expr(f"50 + (50 * n * {n_docs}L) div {max(n_terms or 0, 1)}L")
    normed = found.where(F.octet_length("bag") > 0).select("doc_id", "bag", norm.alias("m"))

    def classes_by(keyed: DataFrame) -> DataFrame:
        return staged(keyed.groupBy("class", "bag", "m").agg(F.min("doc_id").alias("first")), "classes")

    keyed = normed.withColumn("class", digest(F.col("bag"), F.col("m")))
    classes = classes_by(keyed)
    if classes.groupBy("class").count().where("count > 1").limit(1).count():
        keyed = normed.withColumn("class", F.concat("bag", F.encode(F.col("m").cast("string"), "UTF-8")))
        classes = classes_by(keyed)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = weighted.value
        n_items, lot = len(own.ids), max(1, CELLS // len(own.ids))
        none = np.zeros(0, np.int64)
        item, score, first, name = none, none, none, np.zeros(0, object)
        floor = np.ones(n_items, np.int64)  # what a score must reach to count
        for batch in batches:
            for i in range(0, batch.num_rows, lot):
                part = batch.slice(i, lot)
                table = scores(own, part.column("bag").to_pylist(), part.column("m").to_numpy())
                row, of = np.nonzero(table >= floor)
                names = np.array([*part.column("class").to_pylist(), None], object)[:-1]
                item, score = np.append(item, of), np.append(score, table[row, of])
                first = np.append(first, part.column("first").to_numpy()[row])
                name = np.append(name, names[row])
                keep = best_of(item, score, first, best)
                item, score, first, name = item[keep], score[keep], first[keep], name[keep]
                full = np.bincount(item, minlength=n_items) >= best
                last = np.searchsorted(item, np.arange(n_items), "right") - 1
                floor[full] = score[last[full]]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(item), pa.array([own.ids[x] for x in item.tolist()], pa.int64()), pa.array(score), pa.array(first),
                pa.array(name.tolist(), pa.binary()),
            ],
            names=["item", "item_id", "score", "first", "class"],
        )

    candidates = classes.mapInArrow(scored, "item long, item_id long, score long, first long, class binary")
    by_class = Window.partitionBy("item").orderBy(F.desc("score"), "first", "class")
    chosen = candidates.withColumn("nth", F.row_number().over(by_class)).where(F.col("nth") <= best)
    chosen = staged(chosen.drop("nth", "first"), "chosen")
    by_key = Window.partitionBy("class").orderBy("doc_id")
    members = keyed.select("class", "doc_id").withColumn("nth", F.row_number().over(by_key)).where(F.col("nth") <= best)
    opened = members.drop("nth").join(chosen, "class")
    by_score = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    placed = opened.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= best)
    return placed.select("item_id", "rank", F.nullif(F.col("doc_id"), F.lit(NO_KEY)).alias("doc_id"), "score")
