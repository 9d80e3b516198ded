"""Arrow batches of texts as flat byte arrays, and word hashing over them.

A batch of documents is one byte buffer with offsets; all functions here work on that buffer, so
that Python runs per batch (or per document), never per character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer text makes a slice of its own.
SLICE_BYTES = 1 << 20

_rng = np.random.default_rng(0x5EED)
_BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_CODE = _BYTE_CODE[_LOWER]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; as many as a slice needs are kept, those of a longer text are not."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) == SLICE_BYTES + 1:
            _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer of 64 bits (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def text_slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets) of runs of rows with about ``limit`` bytes; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (bytes) of all maximal runs without white space, and for each text the index of its first word (one more entry than texts)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = _IS_SPACE[data]
    begins = ~space
    ends = ~space
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = space[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    before[edges] = True
    after[edges - 1] = True
    starts = np.flatnonzero(begins & before)
    stops = np.flatnonzero(ends & after) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, A-Z taken as a-z if ``lower``."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER_CODE if lower else _BYTE_CODE)[data] * _power(_BASE, len(data), "base"), out=total[1:])
    return mix((total[stops] - total[starts]) * _power(_BASE_INV, len(data) + 1, "inverse")[starts] + (stops - starts).astype(np.uint64))
