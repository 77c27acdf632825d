"""Hashes of words and of runs of words, as arrays."""

from __future__ import annotations

import numpy as np

_C = np.array([0x9E3779B97F4A7C15], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A hash of each word; with lower, A to Z count as a to z."""
    from xxhash import xxh64_intdigest

    raw = (text or "").encode()
    words = (raw.lower() if lower else raw).split()
    return np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by doubling: run(a + b) = run(a) + C^a * run(b)."""
    powers = {1: _C}
    doubled = {1: words}
    have, out, length = 1, None, 0
    while True:
        if n & have:
            if out is None:
                out, length = doubled[have], have
            else:
                m = len(words) - length - have + 1
                out = out[:m] + np.power(_C, np.uint64(length)) * doubled[have][length : length + m]
                length += have
        if have * 2 > n:
            return mix(out[: len(words) - n + 1])
        m = len(words) - 2 * have + 1
        doubled[2 * have] = doubled[have][:m] + powers[have] * doubled[have][have : have + m]
        powers[2 * have] = powers[have] * powers[have]
        have *= 2


def gram_set(words: np.ndarray, width: int) -> np.ndarray:
    """The different runs of `width` words, sorted; of fewer words, the run of all; of none, none."""
    return np.unique(runs(words, min(width, len(words)))) if len(words) else words
