"""Windows of words in flat arrays."""

from __future__ import annotations

import numpy as np

from tidemark.llm.arrays import mix

_ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` words in a row; entry i starts at word i."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += words[j : j + n] * _ODD[j]
    return mix(out)


def inside_one(owner: np.ndarray, size: int) -> np.ndarray:
    """True where the ``size`` words from here on belong to one text."""
    n = len(owner) - size + 1
    return owner[:n] == owner[size - 1 :] if n > 0 else np.zeros(0, bool)


def keyed(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the owner."""
    return mix(hashes + mix(owner.astype(np.uint64) + np.uint64(1)))
