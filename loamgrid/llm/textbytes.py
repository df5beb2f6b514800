"""Vectorised helpers over the UTF-8 bytes of Arrow string columns.

The operators work on whole Arrow batches: the texts of a batch already lie in
one byte buffer, so word boundaries, line boundaries and hashes of substrings
are computed with numpy over that buffer instead of text by text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers of the polynomial hashes.
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1

_powers: dict[tuple[str, int], np.ndarray] = {}


def _byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit values, the same in every process."""
    return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(256 * seed)) * np.uint64(0xD1342543DE82EF95))


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _power(kind: str, seed: int, n: int) -> np.ndarray:
    have = _powers.get((kind, seed))
    if have is None or len(have) < n:
        step = np.uint64(_BASES[seed] if kind == "up" else pow(_BASES[seed], -1, 1 << 64))
        size = max(n, 1 << 20)
        factors = np.full(size, step, dtype=np.uint64)
        factors[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind, seed] = np.cumprod(factors, dtype=np.uint64)
    return have[:n]


class Rolling:
    """Hashes of any substring of ``data`` in constant time each; seeds 0 and 1 give independent ones."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(_byte_table(seed)[data] * _power("up", seed, n), dtype=np.uint64, out=self.prefix[1:])
        self.down = _power("down", seed, n + 1)

    def span(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of data[start:stop] for arrays of positions; the length is part of it."""
        with np.errstate(over="ignore"):
            raw = (self.prefix[stop] - self.prefix[start]) * self.down[start]
            return mix(raw + (stop - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def windows(self, k: int) -> np.ndarray:
        """Hash of every k-byte window, by its start."""
        n = len(self.prefix) - 1
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            return mix((self.prefix[k:] - self.prefix[: n + 1 - k]) * self.down[: n + 1 - k])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null counts as empty) and its n+1 offsets, from 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"") if column.null_count else column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), offsets - offsets[0]
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Give memory that is free back to the system; Python workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of text, or one row."""
    for batch in batches:
        at, n = 0, batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        while at < n:
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield batch.slice(at, stop - at)
            at = stop
    release()


#: Byte classes: A-Z become a-z, and letters, digits, underscore and bytes beyond ASCII form words.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and row of every word; words end where their text ends."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    inside = _WORD[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] |= inside[firsts]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    lasts = firsts[1:] - 1
    ends[lasts] |= inside[lasts]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, stop, np.searchsorted(offsets, start, side="right") - 1


def sliding_min_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its smallest one (the first, if several)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    best, have = np.arange(len(values), dtype=np.int32), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best[:n].astype(np.int64)
