"""URL filtering with a bit-parallel wildcard automaton."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import let_workers_import

#: rule (host, then path) and verdict.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: URLs run through the automaton together.
BATCH = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; null where there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


class GlobAutomaton:
    """All globs at once, as Shift-And masks of several 64-bit words.

    A glob matches a whole text: ``?`` is any character, ``*`` any run without ``/``, ``**`` any run.
    Every glob owns a row of bits, one more than it has characters; bit i says that i characters
    match. A wildcard is a bit that may stay where it is. One step for a character is
    ``(state << 1 & fits[c]) | (state & stays[c])`` on all words of all texts.
    """

    def __init__(self, globs: list[str]):
        fits: list[list[str | None]] = []
        stays: list[dict[int, bool]] = []
        for glob in globs:
            tokens, loops, i = [], {}, 0
            while i < len(glob):
                if glob[i] == "*":
                    wide = glob[i : i + 2] == "**"
                    loops[len(tokens)] = wide or loops.get(len(tokens), False)
                    i += 2 if wide else 1
                else:
                    tokens.append(None if glob[i] == "?" else glob[i])
                    i += 1
            fits.append(tokens)
            stays.append(loops)
        self.first = np.cumsum([0] + [len(t) + 1 for t in fits])
        self.words = max(1, -(-int(self.first[-1]) // 64))
        letters = sorted({c for tokens in fits for c in tokens if c})
        # Code points that no glob names share class 0; "/" has its own, for the narrow wildcard.
        self.classes = {c: n + 1 for n, c in enumerate(sorted({*letters, "/"}))}
        kinds = len(self.classes) + 1
        self.fits, self.stays = np.zeros((2, kinds, self.words), np.uint64)
        self.start = np.zeros(self.words, np.uint64)
        self.last = np.array([self.first[g] + len(t) for g, t in enumerate(fits)], int)
        for g, tokens in enumerate(fits):
            base = int(self.first[g])
            self._set(self.start, base)
            for n, c in enumerate(tokens):
                for kind in range(kinds) if c is None else [self.classes[c]]:
                    self._set(self.fits[kind], base + n + 1)
            for n, wide in stays[g].items():
                for kind in range(kinds):
                    if wide or kind != self.classes["/"]:
                        self._set(self.stays[kind], base + n)
        # A state of nothing but open-ended last bits cannot change any more.
        self.settled = np.zeros(self.words, np.uint64)
        for g, tokens in enumerate(fits):
            if stays[g].get(len(tokens)):
                self._set(self.settled, int(self.last[g]))

    @staticmethod
    def _set(words: np.ndarray, bit: int) -> None:
        words[bit // 64] |= np.uint64(1) << np.uint64(bit % 64)

    def matches(self, texts: list[str]) -> np.ndarray:
        """Boolean (text, glob)."""
        out = np.zeros((len(texts), len(self.last)), bool)
        lengths = np.array([len(t) for t in texts], int)
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        named = np.array(sorted(map(ord, self.classes)), np.uint32)
        kinds = np.zeros(len(codes), np.int64)
        at = np.minimum(np.searchsorted(named, codes), len(named) - 1)
        order = np.array([self.classes[chr(c)] for c in named], np.int64)
        kinds = np.where(named[at] == codes, order[at], 0)
        offset = np.concatenate([[0], np.cumsum(lengths)])[:-1]
        state = np.repeat(self.start[None, :], len(texts), axis=0)
        live = np.arange(len(texts))
        step = 0
        while len(live):
            live = live[lengths[live] > step]
            now = state[live]
            open_ = ((now & ~self.settled) != 0).any(axis=1)
            live, now = live[open_], now[open_]
            kind = kinds[offset[live] + step]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[live] = (moved & self.fits[kind]) | (now & self.stays[kind])
            step += 1
        word, bit = self.last // 64, (self.last % 64).astype(np.uint64)
        out[:] = (state[:, word] >> bit) & np.uint64(1) != 0
        return out


def judged(pages: DataFrame, rules=RULES, url: str = "url", otherwise: str = "allow") -> DataFrame:
    """The rows with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    The canonical form is ``.`` + host + path. A rule fits its host and all subdomains where the path
    starts with the rule's; the longest rule that fits decides, the first of equally long ones.
    Without one the verdict is ``otherwise``. A null URL or one without ``://`` has an empty host and
    path, which no rule fits. ``host``, ``path``, ``rule`` and ``verdict`` replace columns of those
    names. No row moves between tasks; a batch is cut into lots of BATCH URLs, and a URL whose state
    cannot change leaves its lot early; a very long URL is read to its end, one step a character.
    """
    let_workers_import(pages.sparkSession)
    ordered = sorted(rules, key=lambda r: -len(r[0]))
    # The first "*" of a host glob must not reach into the path: subdomains hold no "/".
    globs = ["*." + rule + "**" for rule, _ in ordered]

    @F.pandas_udf("int")
    def first_rule(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = GlobAutomaton(globs)
        for texts in batches:
            parts = []
            for i in range(0, len(texts), BATCH):
                hit = automaton.matches(texts.iloc[i : i + BATCH].tolist())
                parts.append(np.where(hit.any(axis=1), hit.argmax(axis=1), -1))
            yield pd.Series(np.concatenate(parts) if parts else [], dtype="int32")

    names = F.array(*[F.lit(r) for r, _ in ordered])
    verdicts = F.array(*[F.lit(v) for _, v in ordered])
    found = pages.select(
        F.struct("*").alias("record"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path")
    ).withColumn("at", first_rule(F.concat(F.lit("."), "host", "path")))
    made = {
        "host": F.col("host"),
        "path": F.col("path"),
        "rule": F.when(F.col("at") >= 0, F.get(names, F.col("at"))),
        "verdict": F.when(F.col("at") >= 0, F.get(verdicts, F.col("at"))).otherwise(otherwise),
    }
    others = [F.col("record")[c].alias(c) for c in pages.columns if c not in made]
    return found.select(*others, *[c.alias(n) for n, c in made.items()])
