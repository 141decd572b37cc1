"""Vectorised hashing of byte strings, used inside tasks on one text or one small batch at a time.

The hash of bytes i..j is a polynomial prefix difference modulo 2**64, moved to offset 0 by the inverse
power and mixed with the length; equal strings hash alike wherever they stand.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

U = np.uint64
SEGMENT = 1 << 20  # bytes of a very long text hashed at once
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    def cumulative(b: int) -> np.ndarray:
        out = np.full(n + 1, b, U)
        out[0] = 1
        return np.multiply.accumulate(out)

    return cumulative(base), cumulative(pow(base, -1, 1 << 64))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(base, 1 << max(12, int(n).bit_length()))


class Prefix:
    """Hashes of substrings of one byte array: ``at(starts, ends)``."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        pw, self.inverse = powers(base, len(data))
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum((data.astype(U) + U(1)) * pw[: len(data)], out=self.sums[1:])

    def at(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(space, prepend=True, append=True))
    return edge[0::2], edge[1::2]


def word_hashes(data: np.ndarray) -> np.ndarray:
    """A hash per word between ASCII white space, A-Z lowered; a very long text is taken in segments cut between words."""
    starts, ends = word_bounds(data)
    if not len(starts):
        return np.zeros(0, U)
    out, k = [], 0
    while k < len(starts):
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SEGMENT, "right")))
        a, b = starts[k], ends[stop - 1]
        out.append(Prefix(LOWER[data[a:b]]).at(starts[k:stop] - a, ends[k:stop] - a))
        k = stop
    return out[0] if len(out) == 1 else np.concatenate(out)


def shingle_set(text: bytes, q: int) -> np.ndarray:
    """Sorted distinct hashes of runs of ``q`` words; of all words as one run if there are fewer; empty without words."""
    words = word_hashes(np.frombuffer(text, np.uint8))
    q = min(q, len(words))
    if not q:
        return words
    n = len(words) - q + 1
    h = words[:n]
    for j in range(1, q):
        h = mix(h * U(0xFF51AFD7ED558CCD) + words[j : j + n])
    return np.unique(h)
