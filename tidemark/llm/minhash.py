"""Near-duplicates by BagMinHash: signatures of weighted shingles, bands, exact overlap of multisets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidemark.llm.arrays import flat, groups_of_bytes, hash_words, mix, owners, run_starts, word_edges
from tidemark.llm.graph import components
from tidemark.llm.staging import lean, let_workers_import, release, staged
from tidemark.llm.windows import inside_one, window_hashes

SHINGLE = 5
SIMILARITY = 0.8
#: At similarity 0.8 a pair shares no band with a chance of 5 in 100,000.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
BATCH_BYTES = 1 << 20
#: Bits kept of each register, to estimate how alike two nodes are.
PLANES = 4
#: Words of 64 bits that mark a node's units: the fewest, and the most whatever its size.
LEAST_WORDS, MOST_WORDS = 4, 128
#: Nodes of a bucket, after the first, that what is outside its largest class meets before all others.
PIVOTS = 8

_STEP = mix(np.arange(1, 5, dtype=np.uint64)) | np.uint64(1)


def bags(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """owner, shingle, count of the distinct shingles of every text, ordered by owner and shingle.

    A shingle is five words in a row; a text of fewer words is one shingle, one without words has none.
    """
    n = len(offsets) - 1
    starts, ends = word_edges(data, offsets)
    owner = owners(offsets, starts)
    words = hash_words(data, starts, ends)
    one = np.flatnonzero(inside_one(owner, SHINGLE))
    shingle, of = window_hashes(words, SHINGLE)[one], owner[one]
    counts = np.bincount(owner, minlength=n)
    first = np.cumsum(counts) - counts
    short = [
        (t, window_hashes(words[first[t] : first[t] + counts[t]], int(counts[t]))[0])
        for t in np.flatnonzero((counts > 0) & (counts < SHINGLE))
    ]
    if short:
        of = np.concatenate([of, np.array([t for t, _ in short], of.dtype)])
        shingle = np.concatenate([shingle, np.array([h for _, h in short], np.uint64)])
    order = np.lexsort((shingle, of))
    of, shingle = of[order], shingle[order]
    at = np.flatnonzero(run_starts(of, shingle))
    return of[at], shingle[at], np.diff(np.append(at, len(of)))


def signatures(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """BagMinHash: (n, m) register values; two texts agree in a register with their weighted Jaccard's chance.

    Weights are whole numbers, cut into the levels [0,1), [1,2), [2,4), [4,8), … An element runs one
    Poisson process for every level up to its weight, with a rate of m times the level's width, seeded by
    element and level. A point draws a register and a unit within the level, and counts if the unit
    lies below the weight. A register keeps its earliest point. A process yields its points in order
    of time and stops once it is later than all of its text's registers, so a text costs
    about m log m points, and its elements one each, instead of m for every unit of weight.
    """
    levels = np.frexp(np.maximum(count, 1).astype(float) - 0.5)[1].clip(min=0)  # levels above the first
    repeat = levels + 1
    at = np.repeat(np.arange(len(owner)), repeat)
    level = np.arange(len(at)) - np.repeat(np.cumsum(repeat) - repeat, repeat)
    of, weight = owner[at], count[at]
    seed = mix(shingle[at] + mix(level.astype(np.uint64) + np.uint64(77)))
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    time = np.zeros(len(at))
    registers = np.full(n * m, np.inf)
    steps = np.zeros(2, np.uint64)
    while len(of):
        steps += _STEP[:2]
        a, b = mix(seed + steps[0]), mix(seed + steps[1])
        time = time - np.log(((a >> np.uint64(11)) + np.uint64(1)) * 2.0**-53) / (m * width)
        register = ((b >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        unit = low + ((b & np.uint64(0xFFFFFFFF)) * width.astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        counts = unit < weight
        np.minimum.at(registers, (of * m + register)[counts], time[counts])
        latest = registers.reshape(n, m).max(axis=1)
        go = time < latest[of]
        of, seed, low, width, weight, time = of[go], seed[go], low[go], width[go], weight[go], time[go]
    return registers.reshape(n, m)


def band_keys(registers: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(n, bands): a 64-bit key of each band's registers. They are rounded, as machines differ in a last bit."""
    values = registers.astype(np.float32).view(np.uint32).astype(np.uint64).reshape(len(registers), bands, rows)
    out = np.broadcast_to(mix(np.arange(bands, dtype=np.uint64) + np.uint64(1)), (len(registers), bands)).copy()
    for r in range(rows):
        out = mix(out + values[:, :, r])
    return out


def bit_planes(registers: np.ndarray) -> np.ndarray:
    """(n, words): PLANES bits of a hash of each register, bit by bit: all registers' first bits, then their second ones, …"""
    hashes = mix(registers.astype(np.float32).view(np.uint32).astype(np.uint64)) >> np.uint64(64 - PLANES)
    hashes = np.pad(hashes, ((0, 0), (0, -hashes.shape[1] % 64)))
    bits = (hashes[:, None, :] >> np.arange(PLANES, dtype=np.uint64)[:, None]) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8), axis=2).reshape(len(registers), -1).view(np.int64)


def registers_apart(a: str, b: str, words: int = -(-REGISTERS // 64)) -> Column:
    """Registers whose kept bits differ, from columns a0, a1, … and b0, b1, … with the words of ``bit_planes``."""
    apart = F.lit(0)
    for w in range(words):
        planes = [F.col(f"{a}{p * words + w}").bitwiseXOR(F.col(f"{b}{p * words + w}")) for p in range(PLANES)]
        apart = apart + F.bit_count(reduce(Column.bitwiseOR, planes))
    return apart


def most_apart(similarity: float, m: int = REGISTERS) -> int:
    """Registers in which a pair of ``similarity`` or more differs at most, but for a chance of about one in ten million: six deviations."""
    p = (1 - similarity) * (1 - 2.0**-PLANES)
    return math.floor(m * p + 6 * math.sqrt(m * p * (1 - p)))


def unit_bits(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n+1 offsets and the words of bits that the units of each multiset set: a power of two of them, for four bits a unit or more.

    A unit is a shingle's first, second, third … copy. Fewer words hold the same bits, folded.
    """
    of = np.repeat(owner, count)
    copy = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    h = mix(np.repeat(shingle, count) + copy.astype(np.uint64) * _STEP[2])
    size = np.bincount(of, minlength=n)
    words = np.exp2(np.ceil(np.log2(np.maximum(size, 1) / 16))).astype(np.int64).clip(LEAST_WORDS, MOST_WORDS)
    offsets = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(int(offsets[-1]), np.uint64)
    at = offsets[of] + ((h >> np.uint64(6)).astype(np.int64) & (words[of] - 1))
    np.bitwise_or.at(out, at, np.uint64(1) << (h & np.uint64(63)))
    return offsets, out


def own_bits(more: Column, fewer: Column) -> Column:
    """Bits of ``unit_bits`` set in ``more`` but not in ``fewer``, which has as many words or less: each is a unit that the other lacks."""
    alone = F.transform(more, lambda x, i: F.bit_count(x.bitwiseAND(F.bitwise_not(F.get(fewer, i % F.size(fewer))))))
    return F.aggregate(alone, F.lit(0), lambda n, x: n + x)


def enough_shared(a: Column, a_bits: Column, b: Column, b_bits: Column, similarity: float) -> Column:
    """Whether the bits of units leave room for ``similarity``; it never rules out a pair that has it."""
    most = F.when(F.size(a_bits) >= F.size(b_bits), a - own_bits(a_bits, b_bits)).otherwise(b - own_bits(b_bits, a_bits))
    return most >= F.lit((similarity - 1e-9) / (1 + similarity)) * (a + b)


def _digests(owner: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> list[bytes]:
    """128 bits that equal multisets share, whatever the order of their words."""
    halves = []
    for seed in (_STEP[2], _STEP[3]):
        values = mix(shingle + seed) * count.astype(np.uint64)
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
        edge = np.searchsorted(owner, np.arange(n + 1))
        halves.append(mix(upto[edge[1:]] - upto[edge[:-1]]))
    return [a.tobytes() + b.tobytes() for a, b in zip(*halves)]


def text_key(text: Column) -> Column:
    """A text's md5; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def sketched(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, text_key, node, size, bands, planes: a text's multiset as a node, its shingles, its band keys and registers' bits.

    ``node`` is null for a text without words.
    """
    let_workers_import(docs.sparkSession)

    @lean
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("text"))
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                n = j - i
                owner, shingle, count = bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size = np.bincount(owner, count, n).astype(np.int64)
                registers = signatures(owner, shingle, count, n)
                keys, planes = band_keys(registers).view(np.int64), bit_planes(registers)
                empty = size == 0
                nodes = pa.array(_digests(owner, shingle, count, n), pa.binary(), mask=empty)
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
                    for x in (keys, planes)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, n), batch.column("text_key").slice(i, n), nodes, pa.array(size), *lists],
                    names=["doc_id", "text_key", "node", "size", "bands", "planes"],
                )

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(sketch, "doc_id long, text_key binary, node binary, size long, bands array<long>, planes array<long>")


def multisets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """node, shingles, counts, units (their bits) of the texts with the ``wanted`` text keys, one row for each node."""
    rows = docs.select(text_key(F.col(text)).alias("text_key"), F.col(text).alias("text"))
    # Always a merge join: one plan at every size, and large groups of copies can be split.
    rows = rows.join(wanted.hint("merge"), "text_key", "left_semi")

    @lean
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = batch.column("text_key").to_pylist()
            seen, own = {last}, []
            for i, k in enumerate(keys):
                if k not in seen:
                    seen.add(k)
                    own.append(i)
            last = keys[-1] if keys else last
            data, offsets = flat(batch.column("text").take(pa.array(own, pa.int64())))
            for i, j in groups_of_bytes(offsets, BATCH_BYTES):
                owner, shingle, count = bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                edges = pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32))
                places, bits = unit_bits(owner, shingle, count, j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_digests(owner, shingle, count, j - i), pa.binary()),
                        pa.ListArray.from_arrays(edges, pa.array(shingle.view(np.int64))),
                        pa.ListArray.from_arrays(edges, pa.array(count.astype(np.int32))),
                        pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(bits.view(np.int64))),
                    ],
                    names=["node", "shingles", "counts", "units"],
                )

    return rows.mapInArrow(bag, "node binary, shingles array<long>, counts array<int>, units array<long>").dropDuplicates(["node"])


@F.pandas_udf(DoubleType())
def multiset_overlap(sa: pd.Series, ca: pd.Series, sb: pd.Series, cb: pd.Series) -> pd.Series:
    """Weighted Jaccard of two multisets: shared units by all units."""
    out = []
    for x, nx, y, ny in zip(sa, ca, sb, cb):
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        shared = int(np.minimum(nx[i], ny[j]).sum())
        out.append(shared / (int(nx.sum()) + int(ny.sum()) - shared))
    release()
    return pd.Series(out, dtype=float)


def near_duplicates(
    docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """doc_id, text_key, class_id, class_size: one row per document; a class is linked by overlap of ``similarity`` or more.

    Documents with one multiset of shingles are one node; only nodes are compared, so copies are
    never paired. Nodes that share a band meet in its bucket. There the node with the fewest shingles of
    its own is compared with all others, which joins most near copies, and the next PIVOTS nodes with
    what is still outside the bucket's largest class; then everything outside is compared with all
    members of other classes, since nodes of one class need no more links. So no pair of two classes that share a band is left out, and a
    bucket of n near copies costs about n pairs. A pair is spared if its sizes, or the shingles that
    either shares with no other node, rule the similarity out; in the last step also if more registers of the two
    differ than ``most_apart`` allows, or if the bits of their units (``enough_shared``) rule it out. Pairs are verified on the exact multisets.
    Nodes and links are tables; nothing of all documents reaches the driver.

    A very long text is one multiset, held whole by the task that reads it. Texts without words form classes of their own. ``class_id`` is the smallest ``key`` of the class, null if
    it has none. Rows repeated in full are documents like others. An empty table gives no rows.
    """
    sketches = staged(sketched(docs, text, key), "sketches")
    nodes = (
        sketches.where("node IS NOT NULL")
        .groupBy("node")
        .agg(F.min("text_key").alias("text_key"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("planes").alias("planes"))
    )
    nodes = staged(nodes, "nodes")
    rows = nodes.select(F.explode("bands").alias("bucket"), F.struct("node", "size").alias("m"))
    buckets = rows.groupBy("bucket").agg(F.min("m").alias("low"), F.max("m").alias("high"), F.count(F.lit(1)).alias("n"))
    buckets = staged(buckets.where("n > 1"), "buckets")
    crowded = staged(rows.join(buckets.where("n > 2").select("bucket"), "bucket"), "crowded")
    two = buckets.where("n = 2")
    met = two.select("low.node").union(two.select("high.node")).union(crowded.select("m.node")).distinct()
    held = staged(multisets(docs, nodes.join(met, "node").select("text_key"), text), "multisets")

    # Shingles of one node alone cannot be shared; among the crowded nodes, as only those are compared by this.
    members = crowded.select("m.node").distinct()
    units = held.join(members, "node").select("node", F.explode(F.arrays_zip("shingles", "counts")).alias("s"))
    own = (
        units.groupBy("s.shingles")
        .agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("node"), F.min("s.counts").alias("units"))
        .where("n = 1")
        .groupBy("node")
        .agg(F.sum("units").alias("own"))
    )
    crowd = crowded.join(own.withColumnRenamed("node", "_node"), F.col("m.node") == F.col("_node"), "left")
    m = F.struct(F.col("m.node").alias("node"), F.col("m.size").alias("size"), (F.col("m.size") - F.coalesce("own", F.lit(0))).alias("shared"))
    crowd = staged(crowd.select("bucket", m.alias("m")), "crowd")

    def possible(a: Column, b: Column) -> Column:
        most = F.least(a["shared"], b["shared"])
        return most >= F.lit(similarity - 1e-9) * (a["size"] + b["size"] - most)

    def pairs_of(df: DataFrame) -> DataFrame:
        """The possible pairs (a, b), each once."""
        ends = df.where(possible(F.col("a"), F.col("b")) & (F.col("a.node") != F.col("b.node")))
        return ends.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()

    def verified(pairs: DataFrame) -> DataFrame:
        a = held.select(F.col("node").alias("a"), F.col("shingles").alias("sa"), F.col("counts").alias("ca"))
        b = held.select(F.col("node").alias("b"), F.col("shingles").alias("sb"), F.col("counts").alias("cb"))
        found = pairs.join(a, "a").join(b, "b").where(multiset_overlap("sa", "ca", "sb", "cb") >= similarity)
        return staged(found.select("a", "b"), "verified")

    def end(c: str) -> Column:
        return F.struct(F.col(c)["node"].alias("node"), F.col(c)["size"].alias("size"), F.col(c)["size"].alias("shared"))

    by_own = Window.partitionBy("bucket").orderBy((F.col("m.size") - F.col("m.shared")) / F.col("m.size"), "m.node")
    centres = crowd.withColumn("nth", F.row_number().over(by_own)).where(F.col("nth") <= 1 + PIVOTS)
    centres = staged(centres.select("bucket", F.col("m").alias("p"), "nth"), "centres")
    first = two.select(end("low").alias("a"), end("high").alias("b")).union(
        crowd.join(centres.where("nth = 1"), "bucket").select(F.col("m").alias("a"), F.col("p").alias("b"))
    )
    tested = staged(pairs_of(first), "pairs")
    links = verified(tested)
    classes = components(links)

    # Then a few more centres against what is still outside, and at last all that is outside against all.
    for last in (False, True):
        placed = crowd.join(classes, F.col("m.node") == F.col("node"), "left").select(
            "bucket", "m", F.coalesce("component", "m.node").alias("component")
        )
        placed = staged(placed, "crowd-classes")
        parts = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("size"))
        split = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("size", "component")).alias("main"))
        split = split.where("parts > 1").select("bucket", F.col("main.component").alias("main"))
        open_ = placed.join(split, "bucket")
        if last:
            open_ = open_.join(nodes.select(F.col("node").alias("_node"), "planes"), F.col("m.node") == F.col("_node")).drop("_node")
            open_ = open_.join(held.select(F.col("node").alias("_node"), "units"), F.col("m.node") == F.col("_node")).drop("_node")
        open_ = staged(open_, "open")
        words = range(PLANES * -(-REGISTERS // 64) if last else 0)
        bits = ["units"] if last else []
        outside = open_.where("component != main").select(
            "bucket", F.col("m").alias("o"), F.col("component").alias("_component"), *[F.col(c).alias(f"_{c}") for c in bits], *[F.col("planes")[w].alias(f"o{w}") for w in words]
        )
        others = open_ if last else open_.join(centres.where("nth > 1"), "bucket").where("m.node = p.node")
        others = others.select(F.col("bucket").alias("_bucket"), "m", "component", *bits, *[F.col("planes")[w].alias(f"m{w}") for w in words])
        apart = (F.col("bucket") == F.col("_bucket")) & (F.col("component") != F.col("_component"))
        near = F.lit(True)
        if last:
            near = registers_apart("m", "o") <= most_apart(similarity)
            near = near & enough_shared(F.col("m.size"), F.col("units"), F.col("o.size"), F.col("_units"), similarity)
        crossing = others.join(outside, apart & possible(F.col("m"), F.col("o")) & near)
        fresh = pairs_of(crossing.select(F.col("m").alias("a"), F.col("o").alias("b"))).join(tested, ["a", "b"], "left_anti")
        fresh = staged(fresh, "pairs")
        tested = tested.unionByName(fresh)
        new = verified(fresh)
        if new.limit(1).count():
            links = links.unionByName(new)
            classes = components(links)

    placed = sketches.select("doc_id", "text_key", "node").join(classes.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
    placed = staged(placed.select("doc_id", "text_key", "node", F.coalesce("component", "node").alias("component")), "placed")
    sizes = placed.where("component IS NOT NULL").groupBy(F.col("component").alias("_component")).agg(
        F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size")
    )
    joined = placed.join(sizes, F.col("component") == F.col("_component"), "left")
    alone = F.col("component").isNull()
    return joined.select(
        "doc_id", "text_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        F.coalesce("component", F.concat("text_key", F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))).alias("class_key"),
    )


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each class, that of the smallest ``key`` and text hash; columns are unchanged.

    Rows equal in key and text are one document; texts without words stay.
    """
    classes = near_duplicates(docs, similarity, text, key)
    kept = classes.groupBy("class_key").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "text_key")).alias("first"))
    kept = staged(kept.select(F.col("first.k").alias("_k"), F.col("first.text_key").alias("_t")).distinct(), "kept")
    rows = docs.select(
        F.struct("*").alias("record"),
        F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63))).alias("key"), text_key(F.col(text)).alias("text_key"),
    )
    rows = rows.join(kept, (F.col("key") == F.col("_k")) & (F.col("text_key") == F.col("_t")), "left_semi")
    one = Window.partitionBy("key", "text_key").orderBy(F.lit(1))
    return rows.withColumn("n", F.row_number().over(one)).where("n = 1").select("record.*")
