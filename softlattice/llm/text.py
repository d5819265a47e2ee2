"""Vectorised words and shingles of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.  A word's 64-bit hash is
a polynomial over random byte values, taken from prefix sums, so a batch needs
a fixed number of numpy passes and no Python loop over words.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on unsigned 64-bit integers."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9FB21C651E98DF25
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = splitmix(np.arange(1, 257, dtype=np.uint64))
_COEF = splitmix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers up and down of the seed's base."""
    if seed not in _powers or len(_powers[seed][0]) < n:
        size, base, out = max(n, CHUNK + 1), _BASE + 2 * seed * 0x51ED270B, []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[seed] = (out[0], out[1])
    return _powers[seed]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the n+1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    n = len(column)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None and n else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


@dataclass
class Words:
    """``hash`` of every word of a batch, ``start``/``end`` byte positions in ``raw``, ``doc`` offsets (n+1) into them."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def word_bounds(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of each word, and each document's offsets into them."""
    solid = ~_SPACE[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    first[cuts] = solid[cuts]
    last[cuts - 1] = solid[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offs)


def span_hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = True, seed: int = 0) -> np.ndarray:
    """Hash of the (lower-cased, if fold) bytes of each span; spans ascend and do not overlap."""
    value = np.roll(_VALUE, 7 * seed) ^ np.uint64(seed)
    value = value[_LOWER] if fold else value
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):
        low = int(start[i])
        j = max(i + 1, int(np.searchsorted(end, low + CHUNK, side="right")))
        high = int(end[j - 1])
        up, down = _power(high - low + 1, seed)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(value[raw[low:high]] * up[: high - low], out=total[1:])
        s, e = start[i:j] - low, np.maximum(end[i:j], start[i:j]) - low
        out[i:j] = splitmix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words(column: pa.Array) -> Words:
    raw, offs = utf8(column)
    start, end, doc = word_bounds(raw, offs)
    return Words(raw, start, end, doc, span_hash(raw, start, end))


def shingles(w: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of a document's k-word shingles; fewer words make one shingle, none make none."""
    if not len(w):
        return np.zeros(0, np.uint64)
    if len(w) < k:
        return splitmix(np.array([(w * _COEF[: len(w)]).sum(dtype=np.uint64) ^ np.uint64(len(w))], np.uint64))
    return np.unique(window_hash(w, k))


def window_hash(w: np.ndarray, k: int) -> np.ndarray:
    total = np.zeros(len(w) - k + 1, np.uint64)
    for j in range(k):
        total += w[j : len(w) - k + 1 + j] * _COEF[j]
    return splitmix(total)
