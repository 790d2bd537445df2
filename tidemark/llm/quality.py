"""Quality rules whose cutoffs are certified on labelled documents."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma, log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import WHITE, flat, groups_of_bytes, hash_words, owners, per_text, run_starts, word_edges
from tidemark.llm.staging import lean, let_workers_import, staged
from tidemark.llm.windows import inside_one, keyed, window_hashes

SYMBOLS = "#*$%&|<>"
WINDOW = 8
FEWEST_WORDS = 20
MOST_REPEATED_PERCENT = 30
#: Good documents of a stratum that all rules together may reject, and the chance that a bound is wrong.
FALSE_REJECTIONS = 0.05
ERROR = 0.05
BATCH_BYTES = 1 << 20

#: rule: (numerator, denominator, rejects above or below, cutoffs from lenient to strict).
RULES = {
    "symbols": ("n_symbols", "n_words", "above", (2.0, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1)),
    "repeats": ("n_repeat_words", "n_words", "above", (0.25, 0.2, 0.15, 0.1, 0.05)),
    "lines": ("n_dup_lines", "n_lines", "above", (0.9, 0.7, 0.5, 0.4, 0.3, 0.2, 0.1)),
    "long_words": ("word_chars", "n_words", "above", (40.0, 25.0, 18.0, 14.0, 12.0, 10.0, 9.0)),
    "short_words": ("word_chars", "n_words", "below", (1.0, 1.5, 2.0, 2.5, 3.0, 3.5)),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True
_LETTER = ~WHITE
_LETTER[0x80:0xC0] = False  # UTF-8 continuation bytes


def text_counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """COUNTS for every text of a flat batch."""
    n = len(offsets) - 1

    def inside(flags: np.ndarray) -> np.ndarray:
        upto = np.concatenate([[0], np.cumsum(flags)])
        return upto[offsets[1:]] - upto[offsets[:-1]]

    starts, ends = word_edges(data, offsets)
    owner = owners(offsets, starts)
    words = hash_words(data, starts, ends)

    # Lines with a word; each copy of an earlier line of its text counts.
    begins = np.zeros(len(data) + 1, bool)
    begins[1:] = data == 10
    begins[offsets] = True
    line_starts = np.flatnonzero(begins[:-1])
    is_end = np.zeros(len(data) + 1, bool)
    is_end[: len(data)] = data == 10
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    line_ends = np.append(line_starts[1:], len(data)) if len(line_starts) else line_starts
    closed = (line_ends > line_starts) & (data[np.maximum(line_ends - 1, 0)] == 10) if len(data) else line_ends > 0
    line_ends = line_ends - closed
    in_line = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[in_line], line_ends[in_line]
    line_owner = owners(offsets, line_starts)
    lines = np.sort(keyed(hash_words(data, line_starts, line_ends), line_owner))
    first = run_starts(lines)
    order = np.argsort(keyed(hash_words(data, line_starts, line_ends), line_owner), kind="stable")
    again = line_owner[order][~first]

    # Windows found twice or more cover their words.
    one = inside_one(owner, WINDOW)
    at = np.flatnonzero(one)
    keys = keyed(window_hashes(words, WINDOW)[at], owner[at])
    order = np.argsort(keys, kind="stable")
    new = run_starts(keys[order])
    group = np.cumsum(new) - 1
    often = at[order][np.bincount(group)[group] > 1] if len(at) else at
    steps = np.zeros(len(starts) + 1, np.int64)
    np.add.at(steps, often, 1)
    np.add.at(steps, often + WINDOW, -1)
    covered = np.cumsum(steps)[:-1] > 0
    return {
        "n_words": per_text(np.ones(len(owner)), owner, n),
        "word_chars": inside(_LETTER[data]),
        "n_symbols": inside(_SYMBOL[data]),
        "n_dup_lines": per_text(np.ones(len(again)), again, n),
        "n_repeat_words": per_text(covered, owner, n),
        "n_lines": per_text(np.ones(len(line_owner)), line_owner, n),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with COUNTS and ``base_failed``, which replace columns of those names.

    Counts are exact over whole texts; a null text has none and fails. Windows and lines are compared
    by 64-bit hash within a text. No row moves between tasks. A very long text is counted alone, in memory of some ten times its bytes.
    """
    let_workers_import(docs.sparkSession)

    @F.arrow_udf(", ".join(f"{c} long" for c in COUNTS))
    @lean
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            data, offsets = flat(texts)
            parts = [
                text_counts(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for i, j in groups_of_bytes(offsets, BATCH_BYTES)
            ]
            columns = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in COUNTS]
            yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(COUNTS))

    found = docs.select(F.struct("*").alias("record"), counts(F.col(text)).alias("counts")).select("record", "counts.*")
    failed = (F.col("n_words") < FEWEST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return _beside(found.withColumn("base_failed", failed), docs, [*COUNTS, "base_failed"])


def _beside(df: DataFrame, of: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``of``, which ``df`` holds as ``record``, and ``names``, which replace those of their name."""
    return df.select(*[F.col("record")[c].alias(c) for c in of.columns if c not in names], *names)


def rejects(rule: str, cutoff: Column | float) -> Column:
    """Whether a rule with this cutoff rejects a measured document; a null cutoff rejects none."""
    top, bottom, side, _ = RULES[rule]
    value = F.col(top) / F.when(F.col(bottom) > 0, F.col(bottom))
    limit = cutoff if isinstance(cutoff, Column) else F.lit(cutoff)
    return F.coalesce(value > limit if side == "above" else value < limit, F.lit(False))


def binomial_below(k: int, n: int, p: float) -> float:
    """P(at most k of n) at chance p: the incomplete beta function, by its continued fraction."""
    if k >= n:
        return 1.0
    a, b, x = n - k, k + 1.0, 1 - p
    flip = x > (a + 1) / (a + b + 2)
    if flip:
        a, b, x = b, a, p
    front = a * log(x) + b * log1p(-x) - (lgamma(a) + lgamma(b) - lgamma(a + b)) - log(a)
    c, d, tiny = 1.0, 1 - (a + b) * x / (a + 1), 1e-300
    d = 1 / (d or tiny)
    value = d
    for m in range(1, 100_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + step * d) or tiny)
            c = (1 + step / c) or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    share = np.exp(front) * value
    return float(1 - share if flip else share)


def certified_cutoffs(counts: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "lang") -> DataFrame:
    """``stratum`` and one nullable cutoff for each rule.

    ``counts`` is a ``measured`` table; ``labels`` (key, quality, toxic) marks good documents: quality
    1 and not toxic, in all of a document's labels. Of every stratum, null included, the good
    documents that pass the base rules are the holdout; cutoffs are fixed beforehand, so none is
    spent on fitting. A rule's cutoffs are tested from lenient to strict and the last one before
    the first failure is taken, which needs no correction within the rule (fixed-sequence testing).
    A test passes if the exact binomial chance of as few false rejections, were their true share the
    allowed one, is at most the error level: the Clopper-Pearson bound then lies within the allowed
    share. Over strata and rules the level is divided (Bonferroni), and the allowed share is divided
    among the rules. A stratum with too few labels gets no cutoffs and loses nothing. Labels are
    counted in one aggregate; only counts reach the test.
    """
    good = labels.groupBy(F.col(key).alias("_key")).agg(
        (F.coalesce((F.min("quality") == 1) & (F.max("toxic") == 0), F.lit(False))).alias("_good")
    )
    needed = counts.where(~F.col("base_failed")).select(F.col(key).alias("_own"), F.col(stratum).alias(stratum), *COUNTS)
    held = needed.join(good, F.col("_own") == F.col("_key")).where("_good")
    sums = [F.count(F.lit(1)).alias("n")] + [
        F.array(*[F.count(F.when(rejects(rule, c), True)) for c in RULES[rule][3]]).alias(rule) for rule in RULES
    ]
    table = staged(held.groupBy(stratum).agg(*sums), "holdout")
    level = ERROR / (len(RULES) * max(1, table.count()))
    allowed = FALSE_REJECTIONS / len(RULES)

    @F.pandas_udf("int")
    def passed(n: pd.Series, rejected: pd.Series) -> pd.Series:
        out = []
        for size, ks in zip(n, rejected):
            good_so_far = 0
            for k in ks:
                if binomial_below(int(k), int(size), allowed) > level:
                    break
                good_so_far += 1
            out.append(good_so_far)
        return pd.Series(out, dtype="int32")

    cutoffs = table
    for rule, (_, _, _, grid) in RULES.items():
        at = passed(F.col("n"), F.col(rule))
        cutoffs = cutoffs.withColumn(f"_{rule}", F.try_element_at(F.array(*map(F.lit, grid)), F.nullif(at, F.lit(0))))
    return staged(cutoffs.select(stratum, *[F.col(f"_{rule}").alias(rule) for rule in RULES]), "cutoffs")


def judged(counts: DataFrame, cutoffs: DataFrame, stratum: str = "lang") -> DataFrame:
    """A measured table with ``kept``: base rules passed, and no certified rule of its stratum rejects."""
    renamed = cutoffs.select(F.col(stratum).alias("_stratum"), *[F.col(rule).alias(f"_{rule}") for rule in RULES])
    bad = F.col("base_failed")
    for rule in RULES:
        bad = bad | rejects(rule, F.col(f"_{rule}"))
    own = counts.select(F.struct("*").alias("record"), F.col(stratum).alias("_own"), "base_failed", *COUNTS)
    found = own.join(renamed, F.col("_own").eqNullSafe(F.col("_stratum")), "left").withColumn("kept", ~bad)
    return _beside(found, counts, ["kept"])
