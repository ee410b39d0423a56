"""Vectorised hashing of the words of Arrow string columns (numpy, no per-word Python).

A polynomial prefix hash over the UTF-8 bytes (modulo 2**64, odd base, so that powers can be inverted)
gives the hash of any byte range from two prefix values; `mix` spreads it over all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))

#: byte -> folded byte; 0 separates words. ASCII letters are lower-cased, digits and all non-ASCII bytes are kept.
FOLD = np.zeros(256, np.uint8)
for _c in b"abcdefghijklmnopqrstuvwxyz0123456789":
    FOLD[_c] = _c
for _c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
    FOLD[_c] = _c + 32
FOLD[128:] = np.arange(128, 256)


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x += np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty. Offsets start at 0."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.string())
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = col.fill_null("" if not pa.types.is_binary(col.type) else b"")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, data = col.buffers()
    o = np.frombuffer(offs, np.int64 if large else np.int32)[col.offset : col.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


#: byte -> itself; 0 for ASCII white space, which alone separates words
VERBATIM = np.arange(256, dtype=np.uint8)
VERBATIM[[9, 10, 11, 12, 13, 32]] = 0


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of bytes that are `inside` a word; no run goes beyond its row."""
    n = len(inside)
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    first = offsets[:-1]
    first = first[first < n]
    start[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:]
    last = offsets[1:] - 1
    last = last[last >= 0]
    end[last] = inside[last]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all folded words and the first word's index for each row (length rows + 1).

    The hash of a word depends on its bytes only.
    """
    folded = fold[data]
    inside = folded != 0
    if not inside.any():
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    s, e = word_spans(inside, offsets)
    with np.errstate(over="ignore"):
        h = np.zeros(len(s), np.uint64)
        length = e - s
        # words are short: one pass per byte position over the words that are that long
        idx, k = np.arange(len(s)), 0
        while len(idx) and k < 24:
            h[idx] = h[idx] * _BASE + folded[s[idx] + k].astype(np.uint64)
            k += 1
            idx = idx[length[idx] > k]
        for i in idx:  # very long "words": a Horner step over the rest by prefix sums
            rest = folded[s[i] + k : e[i]].astype(np.uint64)
            powers = np.cumprod(np.full(len(rest), _BASE, np.uint64))
            h[i] = h[i] * powers[-1] + (rest[:-1] * powers[:-1][::-1]).sum(dtype=np.uint64) + rest[-1]
    return mix(h), np.searchsorted(s, offsets)
