"""Fill-in-the-middle: texts cut at unit ends that are found eight bytes at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from tidemark.llm.arrays import flat, groups_of_bytes
from tidemark.llm.staging import let_workers_import

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 7
#: Of 100 texts, so many are transformed, and of 100 transformed ones so many put the suffix first.
RATE, SUFFIX_FIRST = 100, 50
#: Text worked on together; a longer text is worked on alone.
BATCH_BYTES = 4 << 20

_ONES = np.uint64(0x0101010101010101)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_TOP = np.uint64(0x8080808080808080)
_SEVEN, _EIGHT = np.uint64(7), np.uint64(8)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes as little-endian uint64, the last word filled with zeros."""
    padded = np.zeros(-(-len(data) // 8) * 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def equal_bytes(words: np.ndarray, byte: int) -> np.ndarray:
    """The top bit of every byte that equals ``byte``; no carry leaves a byte."""
    other = words ^ (_ONES * np.uint64(byte))
    return ~(((other & _LOW7) + _LOW7) | other | _LOW7)


def first_bytes(words: np.ndarray) -> np.ndarray:
    """The top bit of every byte that begins a code point: not 10xxxxxx."""
    return ~(words & (~words << np.uint64(1))) & _TOP


class Marks:
    """Marked bytes (top bits of uint64 words) with rank and select."""

    def __init__(self, marks: np.ndarray):
        self.marks = np.append(marks, np.uint64(0))
        self.upto = np.zeros(len(marks) + 2, np.int64)
        np.cumsum(np.bitwise_count(self.marks), out=self.upto[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each position."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7).astype(np.uint64) << np.uint64(3))) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, nth: np.ndarray) -> np.ndarray:
        """Position of the marked byte with so many marked bytes before it.

        The word is searched in the running counts. In it, a product gives the running count at every
        byte; the bytes whose count does not exceed the wanted one stand before it.
        """
        word = np.searchsorted(self.upto, nth, "right") - 1
        left = (nth - self.upto[word]).astype(np.uint64)
        counts = (self.marks[word] >> _SEVEN) * _ONES
        before = ((left * _ONES | _TOP) - counts) & _TOP
        return word * 8 + np.bitwise_count(before)


def cut_points(
    data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per text: units n, byte ends of prefix and middle, code points of prefix and middle.

    A unit is a line with its ``\\n``; what follows the last ``\\n`` is a unit too.
    """
    words = as_words(data)
    ends, points = Marks(equal_bytes(words, 10)), Marks(first_bytes(words))
    low, high = offsets[:-1], offsets[1:]
    before = ends.rank(low)
    lines = ends.rank(high) - before
    full = high > low
    closed = np.zeros(len(low), bool)
    closed[full] = data[high[full] - 1] == 10
    n = lines + (full & ~closed)
    cuts = []
    for k in (np.minimum(h1 % (n + 1), h2 % (n + 1)), np.maximum(h1 % (n + 1), h2 % (n + 1))):
        inner = (k > 0) & (k <= lines)
        at = np.where(k > 0, high, low)
        at[inner] = ends.select(before[inner] + k[inner] - 1) + 1
        cuts.append(at)
    first, second = cuts
    start, mid = points.rank(low), points.rank(first)
    return n, first, second, mid - start, points.rank(second) - mid


_PARTS = (
    StructType().add("n", LongType()).add("fim", StringType()).add("prefix_chars", LongType()).add("middle_chars", LongType())
)


@F.arrow_udf(_PARTS)
def _transformed(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    for texts, forms, h1, h2 in batches:
        data, offsets = flat(texts)
        forms, h1, h2 = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (forms, h1, h2))
        draws = [np.asarray(h).astype(np.int64) for h in (h1, h2)]
        lots = []
        for i, j in groups_of_bytes(offsets, BATCH_BYTES):
            part, edges = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            n, first, second, prefix_chars, middle_chars = cut_points(part, edges, draws[0][i:j], draws[1][i:j])
            # Prefix, middle and suffix of all texts lie in a row: one array over the same bytes.
            places = np.append(np.column_stack([edges[:-1], first, second]).reshape(-1), edges[-1])
            pieces = pa.LargeStringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(part))
            prefix, middle, suffix = (pieces.take(pa.array(np.arange(k, len(pieces), 3))) for k in range(3))
            whole = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(edges), pa.py_buffer(part))
            p, s, m, none = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
            form = forms.slice(i, j - i)
            plain, spm = pc.equal(form, "plain"), pc.equal(form, "spm")
            out = pc.if_else(
                plain, whole,
                pc.if_else(
                    spm,
                    pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, none),
                    pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, none),
                ),
            )
            null = pa.scalar(None, pa.int64())
            lots.append([
                pa.array(n), out.cast(pa.string()),
                pc.if_else(plain, null, pa.array(prefix_chars)), pc.if_else(plain, null, pa.array(middle_chars)),
            ])
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.concat_arrays([lot[c] for lot in lots]) if lots else pa.array([], k) for c, k in enumerate(kinds)]
        yield pa.StructArray.from_arrays(columns, ["n", "fim", "prefix_chars", "middle_chars"])


def draws(key: Column, seed: int = SEED) -> list[Column]:
    """Four numbers below 2**32 from the seed and the key; a null key counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def filled_middle(
    docs: DataFrame, text: str = "text", key: str = "doc_id", seed: int = SEED, rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
) -> DataFrame:
    """record (the row), n, form, fim, prefix_chars, middle_chars: texts rearranged for filling in the middle.

    A text is cut into lines; prefix and middle end after seeded numbers of them. ``form`` is ``psm``
    (prefix, suffix, middle), ``spm`` (suffix first) or ``plain``: the text as it is, because it is empty, holds
    a sentinel or is not drawn. ``fim`` is the new text; the counts of code points are null if plain.

    Line ends and code points are marked eight bytes at a time in uint64 words, counted by word, and
    a cut is found by searching the running counts and then within one word. Rows stay where they are: no shuffle,
    and a task holds one Arrow batch, or one longer text. A null text is an empty one. Rows with equal or null
    keys draw alike. An empty table gives no rows; no column name clashes, as the row is kept in ``record``.
    """
    let_workers_import(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("record"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(key).alias("key"))
    h1, h2, h3, h4 = draws(F.col("key"), seed)
    held = F.lit(False)
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        held = held | F.contains(F.col("text"), F.lit(sentinel))
    form = (
        F.when((F.col("text") == "") | held | (h3 % 100 >= rate), "plain")
        .when(h4 % 100 < suffix_first, "spm")
        .otherwise("psm")
    )
    formed = rows.select("record", "text", form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    done = formed.select("record", "form", _transformed("text", "form", "h1", "h2").alias("out"))
    return done.select("record", "out.n", "form", "out.fim", "out.prefix_chars", "out.middle_chars")


def restored(fim: Column, form: Column) -> Column:
    """The text that ``filled_middle`` was given, from its output and form alone.

    A transformed text holds no sentinel of its own, and none arises where parts meet, as no sentinel
    begins with another's end; so the three sentinels found are the ones put in.
    """
    parts = F.split(fim, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "plain", fim)
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.concat(parts[1], parts[3], parts[2]))
    )
