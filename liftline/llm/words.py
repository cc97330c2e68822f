"""Words of UTF-8 texts as byte ranges, and 64-bit hashes of words and of word windows, in numpy.

Equal words have equal hashes wherever they stand. Hashes only find candidates: who uses them compares words.
"""

from __future__ import annotations

import numpy as np
import xxhash

PIECE = 1 << 20
_MASK = (1 << 64) - 1
_BASE, _STEP, _MIX = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words that white space parts: all but 09-0D and 20.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[9, 10, 11, 12, 13, 32]] = False
#: Digits, letters and all bytes beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = True
ALNUM[128:] = True


def _power(base: int, n: int) -> np.ndarray:
    if base not in _powers or len(_powers[base]) < n:
        size = min(PIECE, 1 << max(16, (n - 1).bit_length()))
        steps = np.full(size, base, dtype=np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def word_ranges(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes for which inside holds."""
    mark = np.zeros(len(data) + 2, dtype=np.int8)
    mark[1:-1] = inside[data]
    edges = np.flatnonzero(mark[1:] != mark[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each word's bytes: differences of a running polynomial, taken piece by piece."""
    out = np.empty(len(starts), dtype=np.uint64)
    inverse = pow(_BASE, -1, 1 << 64)
    a = 0
    while a < len(starts):
        first = int(starts[a])
        b = max(a + 1, int(np.searchsorted(ends, first + PIECE, side="right")))
        last = int(ends[b - 1])
        if last - first > PIECE:  # a word longer than a piece stands alone
            out[a] = xxhash.xxh64_intdigest(data[first:last].tobytes())
        else:
            values = data[first:last].astype(np.uint64)
            values += np.uint64(1)
            values *= _power(_BASE, last - first)
            sums = np.zeros(last - first + 1, dtype=np.uint64)
            np.cumsum(values, out=sums[1:])
            at = starts[a:b] - first
            h = (sums[ends[a:b] - first] - sums[at]) * _power(inverse, last - first)[at]
            h ^= h >> np.uint64(32)
            h *= np.uint64(_MIX)
            h ^= h >> np.uint64(29)
            out[a:b] = h
        a = b
    return out


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = words[:n].copy()
    for i in range(1, size):
        out *= np.uint64(_STEP)
        out += words[i : n + i]
    out ^= out >> np.uint64(31)
    out *= np.uint64(_MIX)
    out ^= out >> np.uint64(33)
    return out


def covered(starts: np.ndarray, size: int, words: int) -> np.ndarray:
    """Which of so many words are inside a window of that size that begins at one of starts."""
    change = np.zeros(words + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + size, words), -1)
    return np.cumsum(change[:-1]) > 0
