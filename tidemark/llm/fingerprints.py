"""Near-duplicates by SimHash: deletion variants of three segments, joined, verified, and joined into components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.arrays import flat, groups_of_bytes, owners, word_edges
from tidemark.llm.graph import components
from tidemark.llm.staging import let_workers_import, staged

SHINGLE = 4
SEED = 42
BITS = 64
#: Bits in which linked fingerprints may differ.
DISTANCE = 4
#: Bucket size beyond which pairs cost more than the midpoints of its fingerprints: half of 64 buckets of this size.
CROWD = 64
#: A fingerprint with one in so many documents or more is joined by broadcast: there are at most as many of those.
HEAVY = 1024
BATCH_BYTES = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def spaced_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of all texts in lower case with one space after each: bytes, starts, ends, owner."""
    starts, ends = word_edges(data, offsets)
    owner = owners(offsets, starts)
    size = ends - starts
    last = np.cumsum(size + 1)
    first = last - size - 1
    total = int(last[-1]) if len(last) else 0
    out = np.full(total, 32, np.uint8)
    inside = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)  # each word's space is skipped
    out[inside] = _LOWER[data[np.arange(len(inside)) + np.repeat(starts - (np.cumsum(size) - size), size)]]
    return out, first, last - 1, owner


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The 64-bit SimHash of each text of a flat batch; zero without words."""
    n = len(offsets) - 1
    text, first, last, owner = spaced_words(data, offsets)
    counts = np.bincount(owner, minlength=n)
    shingles = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    out = np.zeros(n, np.uint64)
    if not len(first):
        return out
    of = np.repeat(np.arange(n), shingles)
    word_first = np.cumsum(counts) - counts
    begin = word_first[of] + np.arange(len(of)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    end = np.minimum(begin + SHINGLE, (word_first + counts)[of]) - 1
    raw, digest = text.tobytes(), xxhash.xxh64_intdigest
    places = zip(first[begin].tolist(), last[end].tolist())
    hashes = np.fromiter((digest(raw[s:e], SEED) for s, e in places), np.uint64, len(of))
    full = np.flatnonzero(shingles)
    edges = np.cumsum(shingles)[full] - shingles[full]
    half = shingles[full]
    for low in range(0, BITS, 8):
        bits = np.unpackbits(hashes.view(np.uint8)[low // 8 :: 8], bitorder="little").reshape(-1, 8)
        often = 2 * np.add.reduceat(bits, edges, axis=0, dtype=np.int64) > half[:, None]
        out[full] |= np.packbits(often, axis=1, bitorder="little")[:, 0].astype(np.uint64) << np.uint64(low)
    return out


@F.arrow_udf(LongType())
def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's SimHash as a signed 64-bit number; null counts as empty."""
    for texts in batches:
        data, offsets = flat(texts)
        lots = [
            fingerprints(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for i, j in groups_of_bytes(offsets, BATCH_BYTES)
        ]
        yield pa.array(np.concatenate(lots).view(np.int64) if lots else np.zeros(0, np.int64))


def segments(distance: int = DISTANCE, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width): the fewest segments of which one differs by at most one bit."""
    count = distance // 2 + 1
    widths = [bits // count + (i < bits % count) for i in range(count)]
    return [(sum(widths[:i]), w) for i, w in enumerate(widths)]


def _signed(number: int) -> Column:
    """A 64-bit pattern as a long."""
    return F.lit(number - (1 << 64) if number >> 63 else number).cast("long")


def variants(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """fp, slot, part: each segment of a fingerprint with one of its bits struck out.

    ``slot`` is that bit, which also tells the segment. Segments that differ in one bit share the one
    variant without it; equal ones share all.
    """
    both = []
    for low, width in segments(distance):
        mask = ((1 << width) - 1) << low
        both += [F.struct(F.lit(b).alias("slot"), F.col("fp").bitwiseAND(_signed(mask & ~(1 << b))).alias("part")) for b in range(low, low + width)]
    return nodes.select("fp", F.inline(F.array(*both)))


def apart(a: Column, b: Column) -> Column:
    """Bits in which two fingerprints differ."""
    return F.bit_count(a.bitwiseXOR(b))


def links(nodes: DataFrame, distance: int = DISTANCE, crowd: int = CROWD) -> DataFrame:
    """a, b: enough links between distinct fingerprints ``fp`` to join all that are ``distance`` or fewer bits apart.

    Variants are joined on equality and the pairs verified; a pair is taken where its segments differ
    in the bit struck out, or, if they are equal, in the segment's first bucket only. Buckets of more than ``crowd`` fingerprints are not paired.
    Their fingerprints go to all numbers within half the distance of them: any two that are ``distance``
    apart share such a midpoint, and any two that share one are no further apart, so a chain of each
    midpoint's fingerprints holds just the right links, in proportion to their number. Neither can hold a
    large share of the rows: a bucket has one of a fingerprint's 64 rows, a midpoint one of 2,081.
    """
    rows = variants(nodes, distance)
    sized = rows.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("slot", "part")))
    met = staged(sized.where("n > 1"), "buckets")

    few = met.where(F.col("n") <= crowd)
    one = few.select("slot", "part", F.col("fp").alias("a"))
    two = few.select("slot", "part", F.col("fp").alias("b"))
    struck = F.getbit(F.col("a").bitwiseXOR(F.col("b")), F.col("_slot")) == 1
    same = F.lit(False)
    for low, width in segments(distance):
        mask = ((1 << width) - 1) << low
        same = same | ((F.col("_slot") == low) & (F.col("a").bitwiseAND(_signed(mask)) == F.col("b").bitwiseAND(_signed(mask))))
    two = two.withColumnsRenamed({"slot": "_slot", "part": "_part"})
    near = (
        (F.col("slot") == F.col("_slot")) & (F.col("part") == F.col("_part")) & (F.col("a") < F.col("b"))
        & (apart(F.col("a"), F.col("b")) <= distance) & (struck | same)
    )
    paired = one.join(two, near).select("a", "b")
    return paired.unionByName(midpoint_links(met.where(F.col("n") > crowd).select("fp").distinct(), distance)).distinct()


def midpoint_links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """a, b: chains of the fingerprints ``fp`` around each number within half of an even ``distance``."""
    masks = [sum(1 << b for b in bits) for r in range(distance // 2 + 1) for bits in combinations(range(BITS), r)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    flips = F.expr(f"array({', '.join(f'{m}L' for m in masks)})")
    around = nodes.select("fp", F.explode(F.transform(flips, lambda m: F.col("fp").bitwiseXOR(m))).alias("midpoint"))
    chain = Window.partitionBy("midpoint").orderBy("fp")
    return around.select(F.col("fp").alias("b"), F.lag("fp").over(chain).alias("a")).where("a IS NOT NULL").select("a", "b").distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, fingerprint, component_id, component_size: one row for each document.

    Words are runs without ASCII white space, A-Z in lower case; a shingle is four words with single spaces,
    repeats included, or the whole text if it has fewer. A bit of the fingerprint is set if it is set in
    over half of the shingles' XXH64 with seed 42. Documents whose fingerprints differ in ``distance`` bits or fewer
    are linked; ``component_id`` is the smallest ``key`` of all that links reach, null if none has a key.

    Null and empty texts and those without words have the fingerprint zero, which is linked like any other. Only distinct
    fingerprints are compared, so equal texts are never paired. Rows repeated in full are documents like others; an empty
    table gives no rows. A text is read whole, and a task holds one Arrow batch. Fingerprints and links stay
    tables. A fingerprint of very many documents reaches them by broadcast, of 1,024 rows at most.
    """
    if distance % 2:
        raise ValueError("distance must be even: midpoints lie at half of it")
    let_workers_import(docs.sparkSession)
    read = docs.select(F.col(key).cast("long").alias("doc_id"), fingerprint(F.col(text)).alias("fp"))
    sketches = staged(read, "fingerprints")
    nodes = staged(sketches.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "nodes")
    found = components(staged(links(nodes.select("fp"), distance), "links")).withColumnRenamed("node", "fp")
    placed = staged(nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp")), "placed")
    classes = placed.groupBy(F.col("component").alias("_component")).agg(
        F.min("least").alias("component_id"), F.sum("n").alias("component_size")
    )
    total = sketches.count()
    known = staged(placed.join(classes, F.col("component") == F.col("_component")).drop("_component", "component", "least"), "known")
    heavy = known.where(F.col("n") * HEAVY >= total).drop("n")
    rest = sketches.join(F.broadcast(heavy.select("fp")), "fp", "left_anti").join(known.where(F.col("n") * HEAVY < total).drop("n"), "fp")
    both = sketches.join(F.broadcast(heavy), "fp").unionByName(rest)
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
