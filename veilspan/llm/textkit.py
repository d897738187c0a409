"""Vectorised text work inside tasks: byte classes, words, hashes and n-grams with NumPy.

All functions look at UTF-8 bytes of a slice of rows laid end to end; nothing ever
crosses the end of a row.  Slices are about half a megabyte, so memory stays small
whatever the batch size, and one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITE = ~WHITE
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ALNUM = np.zeros(256, bool)  # digits, letters after lower-casing, all of non-ASCII
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of consecutive rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = column.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    pa.default_memory_pool().release_unused()  # a worker waits for its next task without what this one needed


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept between calls."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, SLICE_BYTES + 4096), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefix:
    """Hash of any byte range from prefix sums: two equal ranges have equal hashes."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_BASE, n), out=self.sums[1:])
        self.unshift = powers(_BASE_INVERSE, n + 1)

    def ranges(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        raw = (self.sums[ends] - self.sums[starts]) * self.unshift[starts]
        return mix(raw + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hash of data[i:i + width] for each i."""
        raw = self.sums[width:] - self.sums[: len(self.sums) - width]
        return mix(raw * self.unshift[: len(raw)] + np.uint64(width))


def words(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes with inside[byte], cut at row ends."""
    flag = np.zeros(len(data) + 2, np.int8)
    flag[1:-1] = inside[data]
    step = np.diff(flag)
    start, end = step[:-1] == 1, step[1:] == -1
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    both = cuts[(flag[cuts] == 1) & (flag[cuts + 1] == 1)]
    start[both] = True
    end[both - 1] = True
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of each run of n words of one row."""
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    last = len(hashes) - n + 1
    total = np.zeros(last, np.uint64)
    for k in range(n):
        total = total * _BASE + hashes[k : k + last]
    at = np.flatnonzero(row[:last] == row[n - 1 :])
    return at, mix(total[at])


def per_row(row: np.ndarray, n_rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Count, or sum of weights, by row."""
    total = np.bincount(row, weights, n_rows)
    return total.astype(np.int64) if weights is None or weights.dtype != np.float64 else total


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value in values[i:i + width] for each i, the rightmost on ties."""
    best, at, span = values, np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = best[:-step], best[step:]
        take = right <= left
        best, at = np.where(take, right, left), np.where(take, at[step:], at[:-step])
        span += step
    return at
