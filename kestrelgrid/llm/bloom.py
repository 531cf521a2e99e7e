"""Bloom filters built by the executors and merged slice by slice.

A repeat filter keeps, for every cell, whether it was hit once or more often
(two bitmaps). Two filters merge by ``twice = a.twice | b.twice | (a.once & b.once)``,
so a key that occurs twice anywhere has all its cells in ``twice``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import map_arrow
from .text import mix

SLICE_CELLS = 1 << 19
#: The largest filter that is broadcast: 16 MB. More keys raise the rate of false positives, never lose a repeat.
MOST_CELLS = 1 << 27
#: Keys that a task holds at a time; their cells become slices, so no task holds a whole filter.
LOT = 1 << 20


def cells_for(keys: int, each: int = 16, most: int = MOST_CELLS) -> int:
    return 1 << min(most.bit_length() - 1, max(16, int(max(1, keys) * each - 1).bit_length()))


def probes(keys: np.ndarray, cells: int) -> list[np.ndarray]:
    """The two cells of each 64-bit key."""
    keys = keys.astype(np.uint64)
    return [(k & np.uint64(cells - 1)).astype(np.int64) for k in (keys, mix(keys))]


def _pack(bits: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(bits).tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), np.uint8)


def _lot(keys: np.ndarray, cells: int, repeats: bool) -> Iterator[tuple[int, bytes, bytes]]:
    cell = np.concatenate(probes(keys, cells))
    cell.sort()
    # a key whose two probes meet in one cell counts as two hits: it can only be a false positive
    again = cell[1:][cell[1:] == cell[:-1]] if repeats else cell[:0]
    edges = np.arange(0, cells + 1, min(cells, SLICE_CELLS))
    for k, (a, b, c, d) in enumerate(zip(*(np.searchsorted(x, e) for x in (cell, again) for e in (edges[:-1], edges[1:])), strict=True)):
        if a < b:
            once, twice = np.zeros((2, min(cells, SLICE_CELLS)), bool)
            once[cell[a:b] - edges[k]] = True
            twice[again[c:d] - edges[k]] = True
            yield k, _pack(once), _pack(twice) if repeats else b""


def slices_of(batches: Iterable[np.ndarray], cells: int, repeats: bool) -> Iterator[tuple[int, bytes, bytes]]:
    """(slice, once, twice) of one task's keys, lot by lot."""
    waiting, held = [], 0
    for keys in batches:
        waiting.append(keys)
        held += len(keys)
        if held >= LOT:
            yield from _lot(np.concatenate(waiting), cells, repeats)
            waiting, held = [], 0
    if held:
        yield from _lot(np.concatenate(waiting), cells, repeats)


SLICE_SCHEMA = "slice int, once binary, twice binary"


def as_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["slice", "once", "twice"])


def _merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    once = twice = None
    for batch in batches:
        for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
            a = _unpack(a)
            b = _unpack(b) if b else np.zeros_like(a)
            once, twice = (a.copy(), b.copy()) if once is None else (once | a, twice | b | (once & a))
    yield as_batch([(key[0].as_py(), zlib.compress(once.tobytes(), 1), zlib.compress(twice.tobytes(), 1))])


def build(keys: DataFrame, column: str, cells: int, repeats: bool) -> np.ndarray:
    """The merged bitmap of a long column: of keys that may occur twice, or of all keys."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols = (b.column(0).drop_null().to_numpy(zero_copy_only=False).view(np.uint64) for b in batches)
        for row in slices_of((c for c in cols if len(c)), cells, repeats):
            yield as_batch([row])

    return merge(map_arrow(keys.select(column), fill, SLICE_SCHEMA), cells, repeats)


def merge(parts: DataFrame, cells: int, repeats: bool) -> np.ndarray:
    merged = parts.groupBy("slice").applyInArrow(_merge, SLICE_SCHEMA).select("slice", F.col("twice" if repeats else "once").alias("bits"))
    out = np.zeros(cells // 8, np.uint8)
    for r in merged.collect():
        bits = _unpack(r["bits"])
        out[r["slice"] * (SLICE_CELLS // 8) :][: len(bits)] = bits
    return out


def holds(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter."""
    out = np.ones(len(keys), bool)
    for cell in probes(keys, len(bitmap) * 8):
        out &= (bitmap[cell >> 3] & (np.uint8(128) >> (cell & 7).astype(np.uint8))) > 0
    return out
