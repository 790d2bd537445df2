"""Language-model scoring: a log-bilinear model with noise-contrastive estimation, in numpy."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.arrays import flat, groups_of_bytes, hash_words, owners, per_text, run_starts, word_edges
from tidemark.llm.staging import lean, let_workers_import, staged

#: Numbers of a word vector, earlier tokens that the network sees.
SIZE, CONTEXT = 16, 2
#: A word has vectors of its own if it is found SIZE times in training, or the root of all tokens over ROOT if that is more.
ROOT = 256
#: Noise rows of a step, and of a token of a rare class; tokens of a step, step size, passes over the training texts.
NOISE, INNER_NOISE, STEP_TOKENS, RATE, ROUNDS = 64, 4, 512, 0.2, 1
#: Where the sums of squared gradients start: of shared parameters, and of a single word's.
DENSE_START, WORD_START = 1e-3, 1e-5
#: A word with at least this part of all training tokens is looked up in a broadcast table.
FREQUENT = 1_000_000
#: Tokens scored together: their scores for all rows of a class stay in a core's cache.
SCORED_TOKENS = 256
#: Contexts whose expected vectors are made together.
EXPECTED = 1 << 13
#: A float's exp and sums of many such are finite and above zero for scores within these bounds.
SAFE = 60
BATCH_BYTES = 1 << 20
#: Text counted or scored at once: a word is sent once with its count, tokens after the same words share a softmax.
LOT_BYTES = 1 << 22
#: Rows of parameters of an Arrow batch.
SENT_ROWS = 1 << 14
OTHER, END = 0, 1


def _powers(done_by: dict) -> tuple[np.ufunc, np.ufunc, float]:
    """Power, logarithm, natural logarithm of the base: 2 where numpy's code in use for it is vector code, as that is quicker, otherwise e."""
    quick = any("AVX512" in code["current"] for kinds in done_by.values() for code in kinds.values())
    return (np.exp2, np.log2, math.log(2)) if quick else (np.exp, np.log, 1.0)


POWER, LOG, UNIT = _powers(np.lib.introspect.opt_func_info(func_name="^exp2$", signature="float32") if hasattr(np.lib, "introspect") else {})

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def held_out(key: Column) -> Column:
    """Whether a document is kept from training; one without a key is not."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 1


@dataclass
class Words:
    """The words of a flat batch, A-Z in lower case."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    owner: np.ndarray
    hashes: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Words:
        data = _LOWER[data]
        starts, ends = word_edges(data, offsets)
        return Words(data, starts, ends, owners(offsets, starts), hash_words(data, starts, ends))

    def strings(self, at: np.ndarray) -> pa.Array:
        """The words at the places ``at``."""
        lengths = self.ends[at] - self.starts[at]
        edges = np.concatenate([[0], np.cumsum(lengths)])
        source = np.arange(int(edges[-1])) + np.repeat(self.starts[at] - edges[:-1], lengths)
        held = [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(self.data[source].tobytes())]
        return pa.Array.from_buffers(pa.large_string(), len(at), held).cast(pa.string())


@dataclass
class Index:
    """Finds hashes among ascending ones: their top bits tell where to begin, with a key for every second slot or fewer."""

    keys: np.ndarray  # with one more, the largest, at the end
    first: np.ndarray
    shift: np.uint64

    @staticmethod
    def of(keys: np.ndarray) -> Index:
        bits = len(keys).bit_length() + 1
        shift = np.uint64(64 - bits)
        slots = np.bincount((keys >> shift).view(np.int64), minlength=1 << bits)
        return Index(np.append(keys, ~np.uint64(0)), np.cumsum(slots) - slots, shift)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of every hash; one past the last for a hash that is not there."""
        at = self.first.take((hashes >> self.shift).view(np.int64))
        left = np.flatnonzero(self.keys.take(at) < hashes)
        while len(left):
            at[left] += 1
            left = left[self.keys.take(at.take(left)) < hashes.take(left)]
        at[self.keys.take(at) != hashes] = len(self.keys) - 1
        return at


def _batches(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[tuple[pa.RecordBatch, Words, int]]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for i, j in groups_of_bytes(offsets, most):
            yield batch.slice(i, j - i), Words.of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), j - i


@dataclass
class Counts:
    """What all training texts hold: counts of words as a table (word, c), and of all tokens."""

    table: DataFrame
    texts: int
    tokens: int
    kinds: int


def counted(rows: DataFrame) -> Counts:
    """Counts over the training rows of ``rows`` (text, held_out); the end of a text is a token too."""

    @lean
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found, _ in _batches(batches, LOT_BYTES):
            order = np.argsort(found.hashes)
            first = np.flatnonzero(run_starts(found.hashes[order]))
            n = np.diff(first, append=len(order))
            yield pa.RecordBatch.from_arrays([found.strings(order[first]), pa.array(n)], names=["word", "n"])

    training = rows.where(~F.col("held_out"))
    table = training.select("text").mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("c"))
    table = staged(table, "word-counts")
    sums = table.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = training.count()
    return Counts(table, texts, sums["n"] + texts, sums["v"] + (texts > 0))


@dataclass
class Model:
    """A class-factored log-bilinear model: P(class | before) * P(row | class, before).

    Row 0 stands for all words without vectors, row 1 for the end of a text, the others for words from the most
    frequent on. A class is ``width`` rows in that order, about the root of their number, so that a
    token is normalised over two such numbers of rows. Parts: vectors as context (``seen``) and as target (``said``, with
    ``bias``), those of the classes (``kind``, ``kind_bias``), one matrix for each distance (``turn``).
    """

    keys: np.ndarray  # hashes of the words, ascending
    ids: np.ndarray  # their rows
    share: np.ndarray  # share of every row among the training tokens
    width: int
    parts: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(hashes: np.ndarray, counts: np.ndarray, other: int, ends: int, seed: int = 5) -> Model:
        ranked = np.lexsort((hashes, -counts))
        row = np.empty(len(hashes), np.int64)
        row[ranked] = np.arange(2, len(hashes) + 2)
        share = np.concatenate([[other, ends], counts[ranked]]).astype(float) + 0.5
        share /= share.sum()
        rng = np.random.default_rng(seed)
        rows = len(share)
        width = math.ceil(math.sqrt(rows))
        of_kind = np.add.reduceat(share, np.arange(0, rows, width))
        parts = {
            "seen": rng.normal(0, 0.1, (rows, SIZE)),
            "said": rng.normal(0, 0.1, (rows, SIZE)),
            "kind": rng.normal(0, 0.1, (len(of_kind), SIZE)),
            "turn": np.stack([np.eye(SIZE)] * CONTEXT) / CONTEXT,
            "bias": np.log(share / of_kind[np.arange(rows) // width]),
            "kind_bias": np.log(of_kind),
        }
        order = np.argsort(hashes)
        return Model(hashes[order], row[order], share, width, {k: v.astype(np.float32) for k, v in parts.items()})

    @staticmethod
    def tokens(row: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and texts of all tokens of words' rows, an end after each text, and the (tokens, CONTEXT) rows before them."""
        counts = np.bincount(owner, minlength=n)
        text = np.repeat(np.arange(n), counts + 1)
        tokens = np.full(len(text), END)
        tokens[np.arange(len(row)) + owner] = row
        before = np.full((len(tokens), CONTEXT), END)
        for d in range(1, CONTEXT + 1):
            same = text[d:] == text[:-d]
            before[d:, d - 1][same] = tokens[:-d][same]
        return tokens, text, before

    def expected(self, before: np.ndarray) -> np.ndarray:
        out = np.zeros((len(before), SIZE), np.float32)
        for i in range(0, len(before), EXPECTED):
            for d in range(CONTEXT):
                out[i : i + EXPECTED] += self.parts["seen"].take(before[i : i + EXPECTED, d], axis=0) @ self.parts["turn"][d]
        return out

    def log_shares(self, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Natural log-probability of every token's row: its class's among classes, and its own within the class."""
        key = np.zeros(len(tokens), np.int64)
        for d in range(CONTEXT):
            key = key * len(self.share) + before[:, d]
        # Tokens by what stands before them: equal contexts have one expected vector and one softmax.
        by_context = np.argsort(key)
        key, tokens = key.take(by_context), tokens.take(by_context)
        new = run_starts(key)
        context = np.cumsum(new) - 1
        q = self.expected(before.take(by_context[new], axis=0))
        del key, new
        kinds = tokens // self.width
        logs = _log_softmax(q, self.parts["kind"], self.parts["kind_bias"], kinds, context)
        order = np.argsort(kinds.astype(np.min_scalar_type(len(self.parts["kind"]))), kind="stable")
        edges = np.append(np.flatnonzero(run_starts(kinds[order])), len(order))
        for i, j in zip(edges[:-1], edges[1:]):
            at = order[i:j]
            low = int(kinds[at[0]]) * self.width
            rows = slice(low, low + self.width)
            seen = context.take(at)
            new = run_starts(seen)
            inside = q.take(seen[new], axis=0)
            logs[at] += _log_softmax(inside, self.parts["said"][rows], self.parts["bias"][rows], tokens.take(at) - low, np.cumsum(new) - 1)
        out = np.empty(len(logs))
        out[by_context] = logs
        return out

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray]], seed: int) -> Touched:
        """NCE steps over (tokens, before) arrays, with Adagrad; how often each row took part."""
        rng = np.random.default_rng(seed)
        n, kinds = len(self.share), len(self.parts["kind"])
        state = self.rows()
        squares = np.full(state.shape, WORD_START, np.float32)
        squares[2 * n :] = DENSE_START
        of_kind = np.exp(self.parts["kind_bias"].astype(float))
        first = self.share[: self.width]
        draws = Draws(rng, of_kind / of_kind.sum()), Draws(rng, first / first.sum())
        times = np.zeros(2 * n + kinds, np.int64)
        total = 0
        for tokens, before in batches:
            total += len(tokens)
            with np.errstate(over="ignore"):
                for i in range(0, len(tokens), STEP_TOKENS):
                    self._step(tokens[i : i + STEP_TOKENS], before[i : i + STEP_TOKENS], rng, draws, state, squares, times)
        self.parts = self.parts_of(state)
        return Touched(total, times[:n], times[n : 2 * n])

    def _step(self, own, seen, rng, draws, state, squares, times) -> None:
        n, width, m = len(self.share), self.width, len(own)
        # Rows of the first class, which most tokens are of, share their noise; rarer ones have their class's at equal chances.
        head, tail = np.flatnonzero(own < width), np.flatnonzero(own >= width)
        kind_noise, head_noise = draws[0].some(), draws[1].some() if len(head) else own[:0]
        low = own[tail] // width * width
        most = np.minimum(width, n - low)
        both = np.empty((len(tail), 1 + INNER_NOISE), np.int64)
        both[:, 0] = own[tail]
        if len(tail):
            both[:, 1:] = low[:, None] + (rng.random((len(tail), INNER_NOISE)) * most[:, None]).astype(np.int64)
        places = [
            own // width + 2 * n, kind_noise + 2 * n, own[head], head_noise, both.ravel(), seen.ravel() + n,
            np.arange(len(times), len(state)),  # the rows of "turn" stand last
        ]
        edges = np.cumsum([len(p) for p in places]).tolist()
        groups = Groups.of(np.concatenate(places))
        held, square = state.take(groups.keys, axis=0), squares.take(groups.keys, axis=0)
        rows = held.take(groups.place, axis=0)
        values = np.empty((edges[-1], SIZE + 1), np.float32)
        context, turn = rows[edges[4] : edges[5], :SIZE].reshape(m, CONTEXT * SIZE), rows[edges[5] :, :SIZE]
        q = np.ones((m, SIZE + 1), np.float32)  # the last number meets the bias
        q[:, :SIZE] = context @ turn
        toward = _against_shared(q, rows[: edges[1]], places[0] - 2 * n, kind_noise, draws[0].logs, values[: edges[1]])
        if len(head):
            inside = slice(edges[1], edges[3])
            toward[head] += _against_shared(q.take(head, axis=0), rows[inside], own[head], head_noise, draws[1].logs, values[inside])
        if len(tail):
            inside = slice(edges[3], edges[4])
            vectors, q_tail = rows[inside].reshape(*both.shape, SIZE + 1), q.take(tail, axis=0)
            scores = np.einsum("tks,ts->tk", vectors, q_tail)
            scores -= np.log(INNER_NOISE / most)[:, None].astype(np.float32)
            scores /= np.float32(-UNIT)
            change = -_chance(scores)
            change[:, 0] += 1
            toward[tail] += np.einsum("tk,tks->ts", change, vectors)[:, :SIZE]
            np.multiply(change[:, :, None], q_tail[:, None, :], out=values[inside].reshape(vectors.shape))
        values[edges[4] :, SIZE] = 0
        values[edges[4] : edges[5], :SIZE] = (toward @ turn.T).reshape(-1, SIZE)
        values[edges[5] :, :SIZE] = context.T @ toward
        gradient = groups.sums(values)
        words = groups.keys[: len(groups.keys) - CONTEXT * SIZE]
        times[words] += groups.times[: len(words)]
        gradient /= m
        change = gradient * gradient
        square += change
        gradient *= RATE
        gradient /= np.sqrt(square, out=change)
        held += gradient
        # A row is written as one value.
        whole = np.dtype((np.void, held.itemsize * (SIZE + 1)))
        state.view(whole)[groups.keys] = held.view(whole)
        squares.view(whole)[groups.keys] = square.view(whole)

    def rows(self) -> np.ndarray:
        """All parameters, SIZE + 1 numbers a row: of words as target, with the bias last, as context, of classes, of "turn"."""
        p, n = self.parts, len(self.share)
        out = np.zeros((2 * n + len(p["kind"]) + CONTEXT * SIZE, SIZE + 1), np.float32)
        out[:, :SIZE] = np.concatenate([p["said"], p["seen"], p["kind"], p["turn"].reshape(-1, SIZE)])
        out[:n, SIZE], out[2 * n : 2 * n + len(p["kind"]), SIZE] = p["bias"], p["kind_bias"]
        return out

    def parts_of(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """The parts that ``rows`` hold."""
        n, kinds = len(self.share), len(self.parts["kind"])
        said, seen, kind, turn = np.split(rows, [n, 2 * n, 2 * n + kinds])
        parts = {
            "said": said[:, :SIZE], "bias": said[:, SIZE], "seen": seen[:, :SIZE], "kind": kind[:, :SIZE], "kind_bias": kind[:, SIZE],
            "turn": turn[:, :SIZE].reshape(CONTEXT, SIZE, SIZE),
        }
        return {k: np.ascontiguousarray(v) for k, v in parts.items()}

    def places(self, touched: Touched) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place, weight and SIZE + 1 numbers of every row of parameters that training changed.

        A word's row weighs as often as it took part, so that tasks without the word don't dilute what others learned.
        """
        said, seen = touched.said.copy(), touched.seen
        said[: self.width] = touched.tokens
        rest = np.full(len(self.parts["kind"]) + CONTEXT * SIZE, touched.tokens)
        weights = np.concatenate([said, seen, rest])
        at = np.flatnonzero(weights)
        return at, weights[at], self.rows()[at]

    def with_places(self, at: np.ndarray, values: np.ndarray) -> Model:
        """The model with these rows of parameters in place of its own."""
        rows = self.rows()
        rows[at] = values
        return Model(self.keys, self.ids, self.share, self.width, self.parts_of(rows))


@dataclass
class Touched:
    """Tokens trained on, and how often each row was a target or noise, and context."""

    tokens: int
    said: np.ndarray
    seen: np.ndarray


class Draws:
    """Noise rows by their shares."""

    def __init__(self, rng: np.random.Generator, share: np.ndarray) -> None:
        self.rng, self.upto = rng, np.cumsum(share)
        self.logs = np.log(NOISE * share).astype(np.float32)

    def some(self) -> np.ndarray:
        return np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE)), len(self.upto) - 1)


def _chance(against: np.ndarray) -> np.ndarray:
    """1 / (1 + exp(-score)) of scores that come as -score / UNIT, in place; a power beyond all floats leaves 0."""
    POWER(against, out=against)
    against += 1
    return np.reciprocal(against, out=against)


def _against_shared(q, rows, own, drawn, logs, values) -> np.ndarray:
    """Gradient of ``q`` without its last number, where all tokens are told from the same noise; those of ``rows`` go to ``values``.

    ``rows`` are those of the tokens' own places, then of the drawn ones.
    """
    said, noise = rows[: len(own)], rows[len(own) :]
    shifted = noise.copy()
    shifted[:, SIZE] -= logs[drawn]
    shifted /= np.float32(-UNIT)
    up = _chance((np.einsum("ts,ts->t", q, said) - logs[own]) / np.float32(UNIT))  # how far a true row is from certain
    down = _chance(q @ shifted.T)
    np.multiply(up[:, None], q, out=values[: len(own)])
    np.negative(down.T @ q, out=values[len(own) :])
    toward = up[:, None] * said[:, :SIZE]
    toward -= down @ noise[:, :SIZE]
    return toward


def _log_softmax(q: np.ndarray, said: np.ndarray, bias: np.ndarray, own: np.ndarray, of: np.ndarray | None = None) -> np.ndarray:
    """Log-probability of row ``own`` of ``said`` for rows ``of``, ascending, of ``q``; for every row in turn without ``of``."""
    of = np.arange(len(own)) if of is None else of
    out = np.empty(len(own))
    lot = min(len(q), SCORED_TOKENS)
    both = (np.concatenate([said, bias[:, None]], axis=1) / np.float32(UNIT)).T
    # No score is further from zero than the lengths of the vectors allow.
    lengths = [math.sqrt(np.einsum("rs,rs->r", rows, rows).max(initial=0)) for rows in (q, said)]
    safe = lengths[0] * lengths[1] + np.abs(bias).max(initial=0) <= SAFE
    ones, room, first = np.ones(len(said), np.float32), np.empty((lot, len(said)), np.float32), np.ones((lot, SIZE + 1), np.float32)
    lots = range(0, len(q), SCORED_TOKENS)
    ends = np.searchsorted(of, np.arange(SCORED_TOKENS, len(q) + SCORED_TOKENS, SCORED_TOKENS)).tolist()
    for i, a, b in zip(lots, [0, *ends], ends):
        some = q[i : i + SCORED_TOKENS]
        first[: len(some), :SIZE] = some
        scores = np.matmul(first[: len(some)], both, out=room[: len(some)])
        rows = of[a:b] - i
        mine = scores[rows, own[a:b]]
        if not safe and (scores.max() > SAFE / UNIT or mine.min() < -SAFE / UNIT):
            most = scores.max(axis=1)
            scores -= most[:, None]
            mine -= most[rows]
        out[a:b] = mine - LOG(POWER(scores, out=scores) @ ones)[rows]
    out *= UNIT
    return out


@dataclass
class Groups:
    """The different ``keys`` of rows, ascending, how often each stands there, and the place of every row's key."""

    keys: np.ndarray
    times: np.ndarray
    place: np.ndarray
    order: np.ndarray  # rows by key
    first: np.ndarray  # where in it a key begins

    @staticmethod
    def of(rows: np.ndarray) -> Groups:
        # Keys with their rows' numbers behind them sort as plain numbers.
        bits = len(rows).bit_length()
        ordered = rows << bits
        ordered += np.arange(len(rows))
        ordered.sort()
        order = ordered & ((1 << bits) - 1)
        ordered >>= bits
        new = run_starts(ordered)
        first = np.flatnonzero(new)
        place = np.empty(len(rows), np.int64)
        place[order] = np.cumsum(new) - 1
        times = np.append(first[1:], len(rows)) - first
        return Groups(ordered[first], times, place, order, first)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the rows' values by key; a key that stands there once needs none, and most others stand there twice."""
        out = values.take(self.order.take(self.first), axis=0)
        twice = np.flatnonzero(self.times == 2)
        out[twice] += values.take(self.order.take(self.first.take(twice) + 1), axis=0)
        several = self.times > 2
        if several.any():
            times = self.times[several]
            rows = self.order[np.repeat(several, self.times)]
            out[several] = np.add.reduceat(values.take(rows, axis=0), np.cumsum(times) - times, axis=0)
        return out


def _hashed(table: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the words of a count table, ascending by hash."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column("word"))
            h = hash_words(data, offsets[:-1], offsets[1:])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("c")], names=["h", "c"])

    found = table.select("word", "c").mapInArrow(hashes, "h long, c long").toArrow()
    h, c = found.column("h").to_numpy().view(np.uint64), found.column("c").to_numpy().astype(np.int64)
    order = np.argsort(h)
    return h[order], c[order]


def fewest(tokens: int) -> int:
    """How often a word must be found in training to have vectors of its own."""
    return max(SIZE, math.ceil(math.sqrt(tokens) / ROOT))


def fitted(rows: DataFrame, counts: Counts, rounds: int = ROUNDS) -> tuple[Model, int]:
    """The trained model, and how many training words its own rows stand for.

    In a round every core of the cluster trains on its part of all training texts, from the same start, and the
    parameters are averaged by row; Spark sums them, so the driver sees one model. As many tasks as cores keep what
    is sent at one model for each core, whatever the size of the input.
    """
    spark = rows.sparkSession
    hashes, known = _hashed(counts.table.where(F.col("c") >= fewest(counts.tokens)))
    model = Model.fresh(hashes, known, counts.tokens - counts.texts - int(known.sum()), counts.texts)
    numbers = [f"v{i}" for i in range(SIZE + 1)]
    schema = "place long, weight long, " + ", ".join(f"{v} float" for v in numbers)
    for turn in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        @lean
        def train(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            own = shared.value.with_places(np.zeros(0, np.int64), np.zeros((0, SIZE + 1), np.float32))
            index, ids = Index.of(own.keys), np.append(own.ids, OTHER)

            def texts():
                for _, found, n in _batches(batches):
                    tokens, _, before = own.tokens(ids.take(index.places(found.hashes)), found.owner, n)
                    yield tokens, before

            touched = own.train(texts(), seed=turn + 1)
            if touched.tokens:
                at, weights, values = own.places(touched)
                for i in range(0, len(at), SENT_ROWS):
                    some = slice(i, i + SENT_ROWS)
                    columns = [pa.array(np.ascontiguousarray(v)) for v in values[some].T]
                    yield pa.RecordBatch.from_arrays([pa.array(at[some]), pa.array(weights[some]), *columns], names=["place", "weight", *numbers])

        training = rows.where(~F.col("held_out")).select("text").coalesce(max(1, spark.sparkContext.defaultParallelism))
        weight = F.col("weight")
        means = [(F.sum(F.col(v) * weight) / F.sum(weight)).cast("float").alias(v) for v in numbers]
        summed = training.mapInArrow(train, schema).groupBy("place").agg(*means).toArrow()
        if summed.num_rows:
            values = np.stack([summed.column(v).to_numpy() for v in numbers], axis=1)
            model = model.with_places(summed.column("place").to_numpy(), values)
    return model, int(known.sum())


def scored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score for every document.

    ``base_score`` is the unigram estimate over exact counts of all training tokens. ``score`` is the
    log10 probability under the log-bilinear model: the two tokens before, each turned by its
    distance's matrix, predict a vector, and softmaxes over classes and over the words of a class give normalised
    probabilities. Every word found ``fewest`` times in training has its own vectors, so the
    vocabulary grows with the input; a rarer word, within "other", has its smoothed share of their counts, so
    that all words, and an unseen one, add up to 1.

    Words with vectors, and those with at least a FREQUENT-th of all training tokens, are looked up in a
    broadcast table of 24 bytes each; all rarer ones are joined by word, and as each is rare, no key is hot.
    Texts are written once with a row number, so that equal keys and texts stay apart. A null text
    is empty and has the end alone; a null key is trained on. A very long text is scored whole, lot by lot. Without training texts every
    share is 1 or uniform; an empty table gives no rows.
    """
    spark = docs.sparkSession
    let_workers_import(spark)
    rows = staged(
        docs.select(
            F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "texts",
    )
    counts = counted(rows)
    model, own_words = fitted(rows, counts)
    # No word with vectors may be among the joined ones: those add their share within "other".
    often = min(math.ceil(max(counts.tokens, 1) / FREQUENT), fewest(counts.tokens))
    frequent, frequent_counts = _hashed(counts.table.where(F.col("c") >= often))
    # The frequent words, those with vectors among them, are looked up once, for row and count.
    ids = np.full(len(frequent) + 1, OTHER)
    ids[Index.of(frequent).places(model.keys)] = model.ids
    shared = spark.sparkContext.broadcast((Model(frequent, ids, model.share, model.width, model.parts), np.append(frequent_counts, 0)))
    base_total = counts.tokens + 0.5 * (counts.kinds + 1)
    other_kinds = counts.kinds - (counts.texts > 0) - len(model.keys)
    other_total = counts.tokens - counts.texts - own_words + 0.5 * (other_kinds + 1)
    trained_texts = counts.texts

    @lean
    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of(shared.value[0].keys)
        for batch, found, n in _batches(batches):
            rare = np.flatnonzero(index.places(found.hashes) == len(index.keys) - 1)
            order = rare[np.lexsort((found.hashes[rare], found.owner[rare]))]
            at = np.flatnonzero(run_starts(found.owner[order], found.hashes[order]))
            first = order[at]
            times = np.diff(np.append(at, len(order)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(found.owner[first])), found.strings(first), pa.array(times)],
                names=["row", "word", "times"],
            )

    @lean
    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, values = shared.value
        index = Index.of(model.keys)
        for batch, found, n in _batches(batches, LOT_BYTES):
            places = index.places(found.hashes)
            tokens, text, before = model.tokens(model.ids.take(places), found.owner, n)
            score = np.bincount(text, model.log_shares(tokens, before), n) / np.log(10)
            c = values.take(places)
            logs = np.where(c > 0, np.log10(c + 0.5), 0)
            # Of rare words, the sum of log10(c + 0.5) comes from the join.
            base = np.bincount(found.owner, logs, n) + np.log10(trained_texts + 0.5)
            others = tokens[np.arange(len(c)) + found.owner] == OTHER
            inside = np.bincount(found.owner[others], logs[others], n)
            n_other = np.bincount(found.owner[others], minlength=n)
            n_tokens = per_text(np.ones(len(c)), found.owner, n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"), batch.column("held_out"), batch.column("row"), pa.array(n_tokens),
                    pa.array(per_text(c > 0, found.owner, n) + (trained_texts > 0)),
                    pa.array(base - n_tokens * np.log10(base_total)),
                    pa.array(score + inside - n_other * np.log10(other_total)),
                ],
                names=["key", "held_out", "row", "n_tokens", "n_known", "base_score", "score"],
            )

    rare = (
        rows.select("row", "text")
        .mapInArrow(rare_words, "row long, word string, times long")
        .join(counts.table.where(F.col("c") < often), "word", "left")
        .groupBy(F.col("row").alias("_row"))
        .agg(
            F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("rare"),
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        )
    )
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, held_out boolean, row long, n_tokens long, n_known long, base_score double, score double"
    found = rows.mapInArrow(texts, schema).join(rare, F.col("row") == F.col("_row"), "left")
    extra = F.coalesce("rare", F.lit(0.0))
    return found.select(
        F.col("key").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(counts.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + extra).alias("base_score"),
        (F.col("score") + extra).alias("score"),
    )
