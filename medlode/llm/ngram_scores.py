"""Sums of n-gram weights over bytes, vectorised; what both text classifiers score with."""

from __future__ import annotations

import numpy as np

from medlode.llm.common import lower_words

_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)
#: Spaces before, between and after texts, so that no n-gram of up to PAD bytes holds bytes of two.
PAD = 6


_DIGITS = bytes(32 if 48 <= c <= 57 else c for c in range(256))


def joined(blobs: list[bytes], digits: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of all blobs with PAD spaces around each, and where each begins (a space early) and ends."""
    gap = b" " * PAD
    data = gap.join([b"", *map(lower_words, blobs), b""])
    if not digits:
        data = data.translate(_DIGITS)
    sizes = np.array([len(b) for b in blobs], np.int64)
    begins = PAD + np.cumsum(sizes + PAD) - sizes - PAD
    return np.frombuffer(data, np.uint8), begins - 1, begins + sizes


def hashed(arr: np.ndarray, sizes: tuple[int, ...], bits: int):
    """For each n the buckets of all n-grams, by where they begin; as long as arr without its last PAD bytes."""
    with np.errstate(over="ignore"):
        h, last = np.zeros(len(arr) - PAD, np.uint32), len(arr) - PAD
        for n in range(1, max(sizes) + 1):
            h = h * _STEP + arr[n - 1 : n - 1 + last] + np.uint32(1)
            if n in sizes:
                yield n, ((h ^ (h >> np.uint32(15)) ^ np.uint32(n)) * _SPREAD) >> np.uint32(32 - bits)


def within_words(arr: np.ndarray, n: int) -> np.ndarray:
    """Whether the n-gram that begins here has a space at its ends at most."""
    last = len(arr) - PAD
    spaces = np.concatenate([[0], np.cumsum(arr == 32, dtype=np.int32)])
    return spaces[n - 1 : n - 1 + last] == spaces[1 : 1 + last]


def sums(values: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The sum of values[begin:end] of each pair."""
    at = np.stack([begins, ends], 1).ravel()
    return np.add.reduceat(np.append(values, values.dtype.type(0)), np.minimum(at, len(values)))[::2]
