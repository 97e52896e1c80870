"""Vectorised word hashing over Arrow string columns.

Texts are taken as UTF-8 bytes. A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z
lower-cased; both rules only touch ASCII, so they hold for any UTF-8 text. Hashes are 64-bit polynomial
prefix hashes over a random byte table, finished with a mixer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER_TABLE = BYTE_TABLE.copy()
LOWER_TABLE[65:91] = LOWER_TABLE[97:123]
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP = np.uint64(0xD6E8FEB86659FD93)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def blocks(data: np.ndarray, offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``limit`` bytes: (first row, end row, bytes, offsets from 0). A longer row stands alone."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


class WordHasher:
    """Hashes of all words of a block of texts; keeps its power tables between blocks."""

    def __init__(self) -> None:
        self._up = self._down = np.zeros(0, np.uint64)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end, first) of each word; ``first[i]:first[i + 1]`` are the words of row i."""
        if len(data) > len(self._up):
            self._up, self._down = powers(BASE, len(data)), powers(INVERSE, len(data))
        inside = np.ones(len(data) + 1, bool)
        inside[-1] = False
        inside[:-1] = (data != 32) & ((data < 9) | (data > 13))
        begin = inside[:-1].copy()
        begin[1:] &= ~inside[:-2]
        edge = offsets[1:-1]
        edge = edge[edge < len(data)]
        begin[edge] |= inside[edge]
        starts = np.flatnonzero(begin)
        stop = ~inside
        stop[edge] = True
        stops = np.flatnonzero(stop)
        ends = stops[np.searchsorted(stops, starts, "right")] if len(starts) else starts
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(LOWER_TABLE[data] * self._up[: len(data)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * self._down[starts]) if len(starts) else np.zeros(0, np.uint64)
        return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingle_sets(words: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its k-word shingles; a row of fewer words has its whole sequence as one."""
    n = len(words)
    if n >= k:
        rolled = words[: n - k + 1].copy()
        for i in range(1, k):
            rolled *= STEP
            rolled += words[i : n - k + 1 + i]
        rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= k:
            out.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            value = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for x in words[a:b]:
                    value = value * STEP + x
            out.append(mix(np.array([value], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
