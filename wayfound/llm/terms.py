"""Terms of many texts at once: Arrow gives every distinct term of a block one code, so equal codes mean equal bytes. Long texts are cut between terms."""
from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa

from .words import LOWER, NOT_ALNUM, split_binary

BLOCK = 1 << 21                 # bytes handled at once


def alphanumeric(data: np.ndarray) -> np.ndarray:
    """Which of the lower-cased bytes belong to terms of letters, digits and everything beyond ASCII."""
    return ~NOT_ALNUM[data]


def latin_letters(data: np.ndarray) -> np.ndarray:
    """Which of the lower-cased bytes belong to letters a-z or characters U+00C0 to U+00FF (in UTF-8: C3 and one more byte)."""
    lead = data == 0xC3
    inside = ((data >= 0x61) & (data <= 0x7A)) | lead
    inside[1:] |= lead[:-1]
    return inside


class Terms(NamedTuple):
    row: np.ndarray             # row of each term, ascending
    code: np.ndarray            # place of each term in ``words``
    words: pa.Array             # distinct terms, binary


def _blocks(off: np.ndarray, raw: np.ndarray):
    """(row of each text, starts, ends) of runs of texts or parts of texts; a long text is cut behind bytes below 0x30, which no term holds."""
    rows, start, end, size = [], [], [], 0
    for r in range(off.size - 1):
        a, b = int(off[r]), int(off[r + 1])
        while a < b:
            stop = b
            if b - a > BLOCK:
                at = a + BLOCK
                while at < b:                                   # the first place to cut from there on
                    found = np.flatnonzero(raw[at:at + BLOCK] < 0x30)
                    if found.size:
                        stop = at + int(found[0]) + 1
                        break
                    at += BLOCK
            if size and size + stop - a > BLOCK:
                yield np.array(rows), np.array(start), np.array(end)
                rows, start, end, size = [], [], [], 0
            rows.append(r)
            start.append(a)
            end.append(stop)
            size += stop - a
            a = stop
    if rows:
        yield np.array(rows), np.array(start), np.array(end)


def term_blocks(values: pa.Array, inside_of):
    """Terms of a binary Arrow array, in blocks; ``inside_of`` tells which lower-cased bytes belong to terms. Rows without terms do not occur; a long row
    may occur in several blocks."""
    raw, off = split_binary(values)
    for rows, start, end in _blocks(off, raw):
        data = LOWER[raw[start[0]:end[-1]]]
        inside = inside_of(data)
        before = np.zeros(data.size, bool)
        before[1:] = inside[:-1]
        before[start - start[0]] = False
        after = np.zeros(data.size, bool)
        after[:-1] = inside[1:]
        after[end - start[0] - 1] = False
        first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        offsets = np.zeros(first.size + 1, np.int32)
        np.cumsum(last - first, out=offsets[1:])
        flat = pa.py_buffer(np.ascontiguousarray(data[inside]))
        coded = pa.Array.from_buffers(pa.binary(), first.size, [None, pa.py_buffer(offsets), flat]).dictionary_encode()
        row = rows[np.searchsorted(start - start[0], first, "right") - 1]
        yield Terms(row, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary)


def pair_counts(row: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, code, count) of the distinct pairs, by row and then code."""
    both, n = np.unique(row * codes + code, return_counts=True)
    return both // codes, both % codes, n
