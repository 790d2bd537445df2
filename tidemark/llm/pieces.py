"""Tokenizing texts piece by piece: every distinct piece of a batch is encoded once.

A text may be cut before the last white-space byte of a run, where a character follows that no
tokenizer rule joins to what stands before it: byte-level and word-end tokenizers both begin a new
pre-token there. The pieces' ids in a row are then exactly the ids of the whole text.
"""

from __future__ import annotations

import json
import os
from itertools import chain

import numpy as np

from tidemark.llm.arrays import WHITE, hash_words

#: Bytes of remembered pieces before a worker starts anew, and text of pieces encoded in one call.
REMEMBERED_BYTES = 32 << 20
CALL_BYTES = 1 << 18
#: Pieces in a row that a byte-level tokenizer encodes as one text.
JOINED = 1 << 10

# May follow a cut: visible ASCII, and lead bytes under which Unicode has no white space.
_PLAIN = np.zeros(256, dtype=bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[0xC3:0xF5] = True
_PLAIN[[0xE1, 0xE2, 0xE3]] = False


def load(path: str):
    """The tokenizer of a file, without truncation and padding."""
    # Each worker has one core: the library's own threads would only add memory.
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def cut(data: np.ndarray, offsets: np.ndarray, never: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of pieces; ``never`` are bytes before which no cut is made."""
    plain = _PLAIN.copy()
    plain[list(never)] = False
    at = np.zeros(len(data) + 1, bool)
    if len(data):
        at[: len(data) - 1] = WHITE[data[:-1]] & plain[data[1:]]
        # White space that ends a text has nothing of its own text after it.
        at[np.maximum(offsets[1:] - 1, 0)] = False
        at[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    at[-1] = False
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], len(data)) if len(starts) else starts
    return starts, ends


def id_bytes(tokenizer) -> np.ndarray | None:
    """Bytes of text behind every id of a byte-level BPE tokenizer; None for others, whose ids don't tell."""
    rules = json.loads(tokenizer.to_str())
    before, model = rules.get("pre_tokenizer") or {}, rules.get("model") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    own = ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout")
    if rules.get("normalizer") or not plain or model.get("type") != "BPE" or any(model.get(k) for k in own):
        return None
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    added = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    out = np.zeros(max([*vocabulary.values(), *added], default=-1) + 1, np.int64)
    for token, i in vocabulary.items():
        out[i] = len(token)
    for i, content in added.items():
        out[i] = len(content.encode())
    return out


class PieceEncoder:
    """Encodes pieces with one tokenizer and remembers them by their 64-bit hash and length.

    Pieces that begin with white space before a plain byte may follow any other piece. A byte-level tokenizer gets
    many of them in a row as one text, which costs it less; the bytes behind the ids show where each one ends.
    """

    def __init__(self, path: str, keep_ids: bool):
        self.tokenizer = load(path)
        self.keep_ids = keep_ids
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Added tokens are found before white space is looked at; a cut before one would change it.
        self.never = frozenset(t.encode()[0] for t in added if t)
        self.id_bytes = id_bytes(self.tokenizer)
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # ascending
        self.slots = np.zeros(0, np.int32)  # of the keys in what follows
        self.counts = np.zeros(0, np.int32)
        self.first = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _follows(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether each piece may stand after another in one text."""
        if self.id_bytes is None:
            return np.zeros(len(starts), bool)
        plain = _PLAIN.copy()
        plain[list(self.never)] = False
        second = np.minimum(starts + 1, len(data) - 1)
        return (ends - starts > 1) & WHITE[data[starts]] & plain[data[second]]

    def _ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's number of ids, and all ids in a row."""
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        lists = [e.ids for e in found]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        return n, np.fromiter(chain.from_iterable(lists), np.uint32, int(n.sum()))

    def _joined_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """``_ids`` of pieces that may follow each other."""
        _, ids = self._ids([b"".join(pieces[i : i + JOINED]) for i in range(0, len(pieces), JOINED)])
        upto = np.cumsum(self.id_bytes[ids])
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(upto, ends)
        # Bytes that are no UTF-8 are replaced, and the bytes behind the ids are others.
        if not len(ids) or upto[-1] != ends[-1] or (upto[last] != ends).any():
            return self._ids(pieces)
        return np.diff(last, prepend=-1), ids

    def _encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, alone: int) -> tuple[np.ndarray, np.ndarray]:
        """Each piece's number of ids, and all ids in a row; after the first ``alone``, pieces may follow each other."""
        raw = data.tobytes()
        counts, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        sizes = np.cumsum(ends - starts)
        i = 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CALL_BYTES, "right")))
            if i < alone:
                j = min(j, alone)
            pieces = [raw[s:e] for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist())]
            n, found = self._ids(pieces) if i < alone else self._joined_ids(pieces)
            counts.append(n)
            if self.keep_ids:
                ids.append(found)
            i = j
        return np.concatenate(counts), np.concatenate(ids)

    def places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """For every piece its place in ``counts`` (and ``first``, ``ids``)."""
        hashes = hash_words(data, starts, ends)
        keys, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if self.keys.nbytes + self.slots.nbytes + self.counts.nbytes + self.first.nbytes + self.ids.nbytes > REMEMBERED_BYTES:
                self._forget()
                known[:] = False
            new = where[~known]
            follows = self._follows(data, starts[new], ends[new])
            ranked = np.argsort(follows, kind="stable")
            counts, ids = self._encode(data, starts[new[ranked]], ends[new[ranked]], len(new) - int(follows.sum()))
            slots = np.empty(len(new), np.int32)
            slots[ranked] = np.arange(len(self.counts), len(self.counts) + len(new))
            fresh = np.searchsorted(self.keys, keys[~known]) + np.arange(len(new))
            held = np.ones(len(self.keys) + len(new), bool)
            held[fresh] = False
            merged = np.empty(len(held), np.uint64), np.empty(len(held), np.int32)
            for out, old, added in zip(merged, (self.keys, self.slots), (keys[~known], slots)):
                out[held], out[fresh] = old, added
            self.keys, self.slots = merged
            self.first = np.concatenate([self.first, np.cumsum(counts) - counts + len(self.ids)])
            self.counts = np.concatenate([self.counts, counts.astype(np.int32)])
            self.ids = np.concatenate([self.ids, ids])
            at = np.searchsorted(self.keys, keys)
        return self.slots[at][back]

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return cut(data, offsets, self.never)

    def ids_of(self, places: np.ndarray) -> np.ndarray:
        """The ids of pieces in a row."""
        counts = self.counts[places]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        jump = np.repeat(self.first[places] - (ends - counts), counts)
        return self.ids[np.arange(total) + jump]


_held: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keep_ids: bool) -> PieceEncoder:
    """This worker's encoder; it outlives a task, and another one takes its place."""
    if (path, keep_ids) not in _held:
        _held.clear()
        _held[path, keep_ids] = PieceEncoder(path, keep_ids)
    return _held[path, keep_ids]


def forget_encoder() -> None:
    """Drop this worker's encoder and what it remembers."""
    _held.clear()
