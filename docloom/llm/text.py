"""Whole-column text work in numpy: word hashes, shingles and rolling hashes over Arrow string buffers.

Texts stay in the UTF-8 buffers that Arrow hands to a task. A batch is cut into slices of 256 KB, so
the working arrays stay small whatever the size of the batch; one text longer than that is a slice of
its own. A null text counts as an empty one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18
SHINGLE_WORDS = 5

U64 = np.uint64
_RNG = np.random.default_rng(20_240_229)
BYTE_VALUES = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 2**64))
STEP = U64(0xD6E8FEB86659FD93)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the table grows by doubling and is kept for the task."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = 1 << max(16, int(n).bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        done = 1
        while done < size:
            have[done : 2 * done] = have[:done] * U64(pow(int(base), done, 2**64))
            done *= 2
        _powers[int(base)] = have
    return have[:n]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int = SLICE_BYTES):
    """Runs [i, j) of texts with at most so many bytes together, or one text."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in the bytes, and each text's first word (one more entry than texts)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    word = ~IS_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, off)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, the same wherever its bytes stand."""
    n = len(data)
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(BASE_INVERSE, n)[starts])


def window_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of so many successive 64-bit values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * STEP + values[k : k + n]
    return mix(total)


def byte_windows(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of the `width` bytes from each offset on, where so many are left."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(BASE_INVERSE, n))


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's first word; A-Z count as a-z."""
    data = LOWER[data] if lower else data
    starts, ends, first = word_spans(data, off)
    return span_hashes(data, starts, ends), first


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int = SHINGLE_WORDS):
    """For each text the sorted distinct hashes of its shingles of `width` words.

    A text of fewer words has its whole word sequence as the one shingle, a text without words none.
    """
    hashes, first = word_hashes(data, off)
    runs = window_hashes(hashes, width)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(runs[a : b - width + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            yield own[keep]
        elif b > a:
            yield window_hashes(hashes[a:b], b - a) ^ U64(b - a)
        else:
            yield hashes[:0]


def text_sets(column: pa.Array, width: int = SHINGLE_WORDS):
    """shingle_sets over a whole column, slice by slice."""
    data, off = buffers(column)
    for i, j in slices(off):
        yield from shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
