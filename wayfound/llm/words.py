"""Words of many texts at once, in numpy: where they start and end, and a 64-bit hash of each. Small helpers of the Arrow functions."""
from __future__ import annotations

from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_all = np.arange(256)
SPACE = (_all == 0x20) | ((_all >= 0x09) & (_all <= 0x0D))
NOT_ALNUM = ~(((_all >= 0x30) & (_all <= 0x39)) | ((_all >= 0x61) & (_all <= 0x7A)) | (_all >= 0x80))      # after lower-casing
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
PIECE = 1 << 19                 # bytes handled at once


@lru_cache(maxsize=4)
def powers(n: int, inverse: bool = False) -> np.ndarray:
    out = np.full(n, _INVERSE if inverse else _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any run of bytes: see ``run_hash``."""
    size = 1 << max(20, int(data.size).bit_length())
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(size)[:data.size], out=out[1:])
    return out


def run_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end): the same for the same bytes, wherever they stand."""
    size = 1 << max(20, int(sums.size - 1).bit_length())
    return mix((sums[end] - sums[start]) * powers(size, True)[start] + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def split_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary Arrow array without nulls."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    off = np.frombuffer(offsets, np.int64, len(values) + 1, values.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]] if raw.size else raw, off - off[0]


def groups_of(offsets: np.ndarray, limit: int = PIECE):
    """Row ranges whose bytes stay near ``limit``; a longer text stands alone."""
    first = 0
    while first < offsets.size - 1:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


class Words(NamedTuple):
    data: np.ndarray        # lower-cased bytes of the rows
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray       # first[r]:first[r+1] are the words of row r


def words_of(raw: np.ndarray, offsets: np.ndarray, breaks: np.ndarray) -> Words:
    """Words of consecutive rows; ``offsets`` start at 0."""
    data = LOWER[raw]
    inside = ~breaks[data]
    before = np.zeros(data.size, bool)
    before[1:] = inside[:-1]
    row_start = offsets[:-1][offsets[:-1] < data.size]
    before[row_start] = False
    after = np.zeros(data.size, bool)
    after[:-1] = inside[1:]
    row_last = offsets[1:][offsets[1:] > 0] - 1
    after[row_last] = False
    start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, start, end, run_hash(prefix_sums(data), start, end), np.searchsorted(start, offsets))


def word_groups(values: pa.Array, breaks: np.ndarray):
    """(first row, last row, Words) for row ranges of bounded size."""
    raw, off = split_binary(values)
    for a, b in groups_of(off):
        yield a, b, words_of(raw[off[a]:off[b]], off[a:b + 1] - off[a], breaks)


def shingle_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbouring words, from their hashes."""
    if h.size < n:
        return np.zeros(0, np.uint64)
    out = np.full(h.size - n + 1, n, np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9FB21C651E98DF25) + h[j:h.size - n + 1 + j]
    return mix(out)
