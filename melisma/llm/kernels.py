"""Vectorised numpy work on the bytes of Arrow string columns: words, shingles, rolling hashes.

Texts are taken in blocks of about BLOCK bytes, so that temporaries stay near that size; a longer text is a block of its own, whose
hashes are made CHUNK bytes at a time.
Hashes are polynomials modulo 2**64 over randomly valued bytes, with an odd base: a substring's hash is a difference of
prefix sums times a power of the base's inverse.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

BLOCK, CHUNK = 1 << 18, 1 << 21
U64 = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240601))
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
BASES = [int(x) | 1 for x in _RANDOM.integers(1 << 60, 1 << 62, 4)]

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[65:91] = IS_WORD[128:] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i up to n at least."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(BLOCK + 4096, n + 1)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            a = np.full(size, b, U64)
            a[0] = 1
            both.append(np.multiply.accumulate(a))
        _powers[base] = got = (both[0], both[1])
        if n > 4 * BLOCK:  # the table of a very long text isn't kept
            del _powers[base]
    return got


def tidy(f: Callable) -> Callable:
    """For functions that a task runs over its batches: at the end, freed memory goes back to the system. Python workers outlive their tasks, and several share an executor's memory."""

    @functools.wraps(f)
    def run(*args, **kwargs):
        try:
            yield from f(*args, **kwargs)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # another C library
                pass

    return run


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U64(31))) * U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(29))) * U64(0xBF58476D1CE4E5B9)
    return x ^ (x >> U64(32))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes; every row is whole."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Prefix sums of values[i] * base**i, from 0."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(base, len(values))[0][: len(values)], out=out[1:])
    return out


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: start and end byte of each word, its row, and the number of words up to each row. Words are runs of ASCII letters, digits and non-ASCII characters."""
    flag = IS_WORD[data]
    start, end = flag.copy(), flag.copy()
    start[1:] &= ~flag[:-1]
    end[:-1] &= ~flag[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    start[inner] = flag[inner]
    end[inner - 1] = flag[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    upto = np.searchsorted(s, offsets)
    return s, e, np.repeat(np.arange(len(offsets) - 1), np.diff(upto)), upto


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    """64-bit hashes of the lower-cased words [s, e). A word that is cut by a chunk's end is the sum of its parts."""
    out = np.zeros(len(s), U64)
    for lo in range(0, len(data), CHUNK):
        hi = min(lo + CHUNK, len(data))
        i, j = int(np.searchsorted(e, lo, "right")), int(np.searchsorted(s, hi))
        if i == j:
            continue
        h = prefix(BYTE_VALUES[LOWER[data[lo:hi]]], base)
        a, b = np.maximum(s[i:j], lo) - lo, np.minimum(e[i:j], hi) - lo
        part = (h[b] - h[a]) * powers(base, hi - lo)[1][a]
        if s[i] < lo:
            part[0] *= U64(pow(base, lo - int(s[i]), 1 << 64))
        out[i:j] += part
    return mix(out)


def whole_hash(data: np.ndarray, base: int) -> np.ndarray:
    """The polynomial of all bytes, as an array of one number."""
    out = np.zeros(1, U64)
    for lo in range(0, len(data), CHUNK):
        out += prefix(BYTE_VALUES[data[lo : lo + CHUNK]], base)[-1:] * U64(pow(base, lo, 1 << 64))
    return out


def shingles(hashes: np.ndarray, upto: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within rows, and each one's row; a row of 1 to k-1 words has one shingle of all its words."""
    counts = np.diff(upto)
    rows = np.repeat(np.arange(len(counts)), counts)
    n = len(hashes)
    out, of = np.zeros(0, U64), np.zeros(0, np.int64)
    if n >= k:
        value = np.zeros(n - k + 1, U64)
        for j in range(k):
            value = (value + hashes[j : n - k + 1 + j]) * U64(BASES[1])
        whole = rows[: n - k + 1] == rows[k - 1 :]
        out, of = mix(value[whole]), rows[: n - k + 1][whole]
    if len(short := np.flatnonzero((counts > 0) & (counts < k))):
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = (extra[has] + hashes[np.minimum(upto[short] + j, n - 1)][has]) * U64(BASES[2])
        order = np.argsort(np.concatenate([of, short]), kind="stable")
        out, of = np.concatenate([out, mix(extra)])[order], np.concatenate([of, short])[order]
    return out, of


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minima of w consecutive values, in about log2(w) passes."""
    step, out = 1, a
    while 2 * step <= w:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(a) - w + 1], out[w - step : w - step + len(a) - w + 1]) if step < w else out
