"""Words of a text and their 64-bit hashes, for all words at once.

Words are runs of ASCII letters and digits and of multi-byte characters, in
lower case.  A word's hash is a polynomial in its bytes modulo 2**64 with an
odd base, taken from running sums and the inverse powers of the base.
"""

from __future__ import annotations

import numpy as np

BASE = 0x9E3779B97F4A7C15
_CLASS = np.zeros(256, np.uint8)  # 0 between words, else the byte itself
for _c in range(256):
    if _c >= 128 or chr(_c).isalnum():
        _CLASS[_c] = _c
_TABLES: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of the base and of its inverse, modulo 2**64."""
    if len(_TABLES[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            row = np.full(size, np.uint64(base))
            row[0] = 1
            _TABLES[i] = np.multiply.accumulate(row)
    return _TABLES[0][:n], _TABLES[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _bytes(text: str | None) -> np.ndarray:
    return _CLASS[np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)]


def words(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words, and their starts and ends in the lower-cased UTF-8 bytes."""
    data = _bytes(text)
    edge = np.diff(np.concatenate(([0], (data != 0).view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, ends
    power, inverse = powers(len(data))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(data.astype(np.uint64) * power)))
    return mix((sums[ends] - sums[starts]) * inverse[starts]), starts, ends


def stems(text: str | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the first n bytes of the words longer than that, and how many different words have each."""
    h, starts, ends = words(text)
    _, first = np.unique(h, return_index=True)
    starts = starts[first][ends[first] - starts[first] > n]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _bytes(text)
    power = powers(n)[0]
    own = data[starts[:, None] + np.arange(n)].astype(np.uint64) @ power
    return np.unique(mix(own + np.uint64(n)), return_counts=True)


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words, from the words' hashes."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(h))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(h * power)))
    return mix((sums[k:] - sums[:n]) * inverse[:n])
