"""Texts of an Arrow batch as flat NumPy arrays: bytes, words, hashes of words and of word windows.

Tasks work on pieces of at most ``PIECE`` bytes (or one document, if it is longer), so their memory does not
depend on the size of a partition or of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_MULTIPLIER = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_WORD_MULTIPLIER = 0xD1342543DE82EF95
_WORD_INVERSE = pow(_WORD_MULTIPLIER, -1, 1 << 64)
SPACES = b" \t\n\x0b\x0c\r"
IS_SPACE = np.isin(np.arange(256), np.frombuffer(SPACES, np.uint8))

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; kept for the next call of this worker."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        known = _powers[base] = np.cumprod(factors)
    return known[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """Bit mixer, so that every part of the hash may be used by itself."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keyed(seed: int) -> np.uint64:
    return mixed(np.array([seed & (2**64 - 1)], np.uint64) + np.uint64(_MULTIPLIER))[0]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = pc.fill_null(column, b"")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE) -> Iterator[tuple]:
    """(rows as RecordBatch, bytes, offsets) for runs of rows with at most ``most`` bytes of text."""
    for batch in batches:
        data, offsets = flat(batch.column(column))
        low, n = 0, batch.num_rows
        while low < n:
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` and, for each row, the index of its first word."""
    if len(data) == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    inside = ~IS_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begins[edges] = inside[edges]
    ends[edges - 1] = inside[edges - 1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans that depend on their bytes alone."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_MULTIPLIER, len(data)), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(data))[starts]
    return mixed(raw + (ends - starts).astype(np.uint64) * np.uint64(_WORD_MULTIPLIER) + keyed(seed))


def window_hashes(hashes: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """Hash of every run of ``size`` consecutive entries; entry i is the run that starts at i."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(_WORD_MULTIPLIER, len(hashes)), out=sums[1:])
    return mixed((sums[size:] - sums[:-size]) * powers(_WORD_INVERSE, len(hashes))[:n] + keyed(seed))


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values, the place of one of each, and for every entry the index of its value."""
    order = np.argsort(x)
    ordered = x[order]
    new = np.ones(len(x), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(x), np.int64)
    inverse[order] = np.cumsum(new) - 1
    return ordered[new], order[new], inverse


def binary(rows: list[bytes]) -> pa.Array:
    return pa.array(rows, pa.binary())
