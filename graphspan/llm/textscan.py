"""Hashes of all words or windows of a text at once, in numpy.

The text's bytes are mapped to random 64-bit values and summed with powers of an
odd base, modulo 2**64.  The hash of any stretch is the difference of two such
sums over the power of its start, so it does not depend on where it stands.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
U64 = np.uint64


def random_values(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=U64) * U64(2) + U64(1)


BYTES = random_values(256, 101)
#: The same with A-Z like a-z.
FOLDED = BYTES.copy()
FOLDED[65:91] = BYTES[97:123]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
PLACES = random_values(8, 102)

_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        for k, b in enumerate((BASE, INVERSE)):
            p = np.full(size, U64(b))
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(29))) * U64(0xC2B2AE3D27D4EB4F)
    return h ^ (h >> U64(32))


def sums(data: np.ndarray, values: np.ndarray = BYTES) -> np.ndarray:
    """len(data) + 1 running sums."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


def stretch_hashes(s: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], lengths included, of the sums s."""
    inverse = powers(len(s))[1]
    return mix((s[ends] - s[starts]) * inverse[starts] + (ends - starts).astype(U64) * U64(0xA0761D6478BD642F))


def word_hashes(text: str | None) -> np.ndarray:
    """A hash for each word in order: runs without ASCII white space, A-Z as a-z."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.zeros(0, U64)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~SPACE[data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return stretch_hashes(sums(data, FOLDED), starts, ends)


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of `width` words; of all words if they are fewer; none without words."""
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(width, len(words))
    n = len(words) - width + 1
    total = np.full(n, U64(width * 0x8BB84B93962EACC9 & (2**64 - 1)))
    for k in range(width):
        total += words[k : k + n] * PLACES[k]
    return np.unique(mix(total))
