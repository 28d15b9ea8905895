"""Hashes of words and of word windows over byte buffers, without a Python loop over words; the SimHash of hashes."""

from __future__ import annotations

import numpy as np

#: Odd 64-bit bases, so that they have inverses modulo 2**64 (fixed values).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03
CHUNK = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a buffer: maximal runs without ASCII white space."""
    word = np.concatenate(([False], ~_SPACE[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASE) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed; words go in chunks, so memory does not grow with the buffer."""
    out = np.empty(len(starts), np.uint64)
    inverse = pow(base, -1, 1 << 64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        low, high = int(starts[i]), int(ends[j - 1])
        # bytes are spread over 64 bits first, so that runs of one byte do not cancel
        terms = _mix(data[low:high].astype(np.uint64) + np.uint64(1)) * _powers(base, high - low)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        a, b = starts[i:j] - low, ends[i:j] - low
        out[i:j] = _mix((sums[b] - sums[a]) * _powers(inverse, high - low)[a] + (b - a).astype(np.uint64))
        i = j
    return out


def windows(hashes: np.ndarray, size: int, base: int = WORD_BASE) -> np.ndarray:
    """Rabin-Karp hash of every ``size`` consecutive words: differences of one running sum."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(hashes * _powers(base, len(hashes)), dtype=np.uint64)))
    return _mix((sums[size:] - sums[:n]) * _powers(pow(base, -1, 1 << 64), n))


def simhash(hashes: np.ndarray) -> int:
    """The 64-bit SimHash of 64-bit hashes: a bit is set if it is set in over half of them."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8", copy=False)
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes), bitorder="little").tobytes(), "little")
