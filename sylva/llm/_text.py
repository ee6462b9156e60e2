"""Words, hashes and n-grams of many texts at once, as flat numpy arrays over the UTF-8 bytes.

A batch is walked in chunks of about a megabyte of text (a longer text is a chunk of its own), so memory stays
bounded by the longest text whatever the batch holds. Hashes are 64 bits: a polynomial over a random byte table,
finished with a multiply-xorshift mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
_rng = np.random.default_rng(20240917)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
FOLDED = _BYTES.copy()
FOLDED[65:91] = _BYTES[97:123]
#: Odd multipliers of the positions in an n-gram.
PLACE = _rng.integers(1, 1 << 62, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def not_blank() -> np.ndarray:
    """Bytes of words that only space and the controls 9 to 13 end."""
    ok = np.ones(256, bool)
    ok[[32, 9, 10, 11, 12, 13]] = False
    return ok


def alphanumeric() -> np.ndarray:
    """Digits, ASCII letters and every byte of a character outside ASCII."""
    ok = np.zeros(256, bool)
    ok[48:58] = ok[65:91] = ok[97:123] = ok[128:] = True
    return ok


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _BASE_INV)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and where each text starts (one more offset than rows)."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, word offset of each row) of the maximal runs of ``inside`` bytes."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.offsets), np.int64)
        m = inside[self.data]
        first = np.zeros(n + 1, bool)
        first[self.offsets] = True
        s, e = m.copy(), m.copy()
        s[1:] &= ~m[:-1] | first[1:n]
        e[:-1] &= ~m[1:] | first[1:n]
        starts, ends = np.flatnonzero(s), np.flatnonzero(e) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, table: np.ndarray = FOLDED) -> np.ndarray:
        """A 64-bit hash of each word; with the default table, A-Z count as a-z."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        up, down = _power(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(table[self.data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[Chunk]:
    """Chunks of a column of texts; null is as empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, len(texts))
        yield Chunk(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def grams(h: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-grams of words inside each row, and the gram offset of each row."""
    n = np.maximum(np.diff(at) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(n)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    m = len(h) - k + 1
    total = h[:m] * PLACE[0]
    for j in range(1, k):
        total = total + h[j : m + j] * PLACE[j]
    starts = np.arange(offsets[-1]) - np.repeat(offsets[:-1], n) + np.repeat(at[:-1], n)
    return mix(total[starts]), offsets


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of the values of each row (along the first axis), 0 for rows without any."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]
