"""Numpy kernels over Arrow string columns: words, 64-bit hashes, shingle sets.

All kernels work on whole texts. Peak memory is about 60 bytes for each byte of
a slice; a slice holds SLICE_BYTES bytes or one text, whichever is more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
WHITE = b"\x20\x09\x0a\x0b\x0c\x0d"

_NONWHITE = np.ones(256, dtype=bool)
_NONWHITE[list(WHITE)] = False
#: Words of letters and digits: ASCII punctuation and control characters part them.
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer; a bijection, so it adds no collisions."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT_CODES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_CODES = _EXACT_CODES[_LOWER.astype(int)]
_STEP = 0xD6E8FEB86659FD93
_STEP_INV = pow(_STEP, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        for k, base in enumerate((_STEP, _STEP_INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.cumprod(out, dtype=np.uint64)
    return _powers


def binary(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column; a null counts as an empty text."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_binary()).fill_null(b"")
    if len(col) == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = col.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(col) + 1, col.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in row slices of about ``limit`` bytes of text."""
    offsets, _ = binary(batch.column(column))
    at, rows = 0, batch.num_rows
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column of texts, with hashes of their A-Z-lower-cased bytes."""

    def __init__(self, col: pa.Array, word_bytes: np.ndarray = _NONWHITE):
        """``word_bytes``: for each byte whether it is part of a word."""
        self.offsets, self.data = offsets, data = binary(col)
        self.rows = len(offsets) - 1
        inside = word_bytes[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
        first[edges] = inside[edges]
        last[edges - 1] = inside[edges - 1]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.start, offsets)  # words of row i: bounds[i] to bounds[i + 1]
        self.counts = np.diff(self.bounds)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), self.counts)

    def hashes(self, fold: bool = True) -> np.ndarray:
        """Hashes of the words, with ``fold`` as if A-Z were in lower case."""
        n = len(self.data)
        up, down = _power_tables(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((_BYTE_CODES if fold else _EXACT_CODES)[self.data] * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def shingles(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds): ``width``-word shingles row by row; a shorter text's whole sequence is one."""
        words, counts = self.hashes(), self.counts
        sizes = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        first = np.repeat(self.bounds[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
        length = np.repeat(np.minimum(counts, width), sizes)
        out = length.astype(np.uint64)
        short = bool(len(length)) and bool((length < width).any())
        for k in range(width):
            if short:
                on = length > k
                out[on] = mix(out[on] * np.uint64(_STEP) + words[first[on] + k])
            else:
                out = mix(out * np.uint64(_STEP) + words[first + k])
        return out, bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run bounds[i]:bounds[i + 1] sorted (in place) and without repeats."""
    edges = bounds.tolist()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    first = bounds[:-1][bounds[:-1] < bounds[1:]]
    new[first] = True
    return values[new], np.concatenate([[0], np.cumsum(new)])[bounds]


def set_hash(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run as a set; runs hold no repeats."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values + np.uint64(0x51ED270B27D0E17B)), dtype=np.uint64)])
    return mix((sums[bounds[1:]] - sums[bounds[:-1]]) ^ mix(np.diff(bounds).astype(np.uint64)))


def list_column(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """An Arrow list column of consecutive runs of ``values``."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
