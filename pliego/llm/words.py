"""Words, lines and rolling windows of whole Arrow batches, as numpy arrays.

A word is a maximal run of bytes other than space and the five control bytes 09 to 0D. UTF-8 has
none of these inside a longer character, so the work is done on bytes. Hashes have 64 bits.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.array([0] + [2 ** (8 * i) - 1 for i in range(1, 9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Cut batches between rows so that each piece has about `most` bytes of text (or one row)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(_lengths(batch.column(column)))
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on after their task, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def _lengths(column: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the n + 1 offsets of its rows. A null is an empty text."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the n + 1 places of the rows' first words among them."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~SPACES[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    first[edges] = inside[edges]
    last[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each stretch of bytes, eight bytes at a time."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _MULTIPLIER + np.uint64(1))
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), np.dtype("<u8"), padded, strides=(1,))
    rows: np.ndarray | slice = slice(None)
    at, left = starts, sizes
    while len(at):
        part = eight[at] & _LOW[np.minimum(left, 8)]
        out[rows] = mix((out[rows] ^ part) * _MULTIPLIER + np.uint64(0x632BE59BD9B4E019))
        more = left > 8
        if not more.any():
            break
        rows = np.flatnonzero(more) if isinstance(rows, slice) else rows[more]
        at, left = at[more] + 8, left[more] - 8
    return out


def windows(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` neighbours (len - width + 1 of them, none if there are too few)."""
    count = len(values) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, np.uint64(width), np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[i : i + count]
        out ^= out >> np.uint64(29)
    return mix(out)


def window_rows(firsts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows over all words in one array: those within one row, as their places and their rows."""
    counts = np.maximum(np.diff(firsts) - width + 1, 0)
    rows = np.repeat(np.arange(len(counts)), counts)
    return np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts) + firsts[:-1][rows], rows


def signed(values: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return values.view(np.int64)
