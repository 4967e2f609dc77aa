"""Words of whole texts as numpy arrays, and 64-bit hashes of word sequences.

A batch of texts is one UTF-8 buffer (as Arrow holds it) with row offsets. Every function below works on the whole
buffer at once; ``chunks`` cuts a batch so that a buffer stays near ``CHUNK_BYTES`` unless one text alone is longer, with ``CHUNK_ROWS`` rows at
most.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

_U = np.uint64
#: An odd multiplier, so that it has an inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values (a new array)."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (1 << 64) - 1)
        x ^= x >> _U(30)
        x *= _U(0xBF58476D1CE4E5B9)
        x ^= x >> _U(27)
        x *= _U(0x94D049BB133111EB)
        x ^= x >> _U(31)
    return x


_BYTE_VALUES = mix(np.arange(256, dtype=np.uint64), 7)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


_POWER_CACHE: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    got = _POWER_CACHE.get(base)
    if got is None or len(got) < n:
        got = _POWER_CACHE[base] = _powers(base, max(n, CHUNK_BYTES + 16))
    return got[:n]


@dataclass
class Words:
    """Words of consecutive rows: ``first[i]:first[i+1]`` are row i's words in ``start``, ``end`` and ``hash``."""

    buffer: np.ndarray
    offsets: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 buffer and row offsets (from 0) of a string array; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    buffer = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return buffer, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, text: int | str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``limit`` bytes of text and ``CHUNK_ROWS`` rows at most, one row at least."""
    n = batch.num_rows
    if not n:
        return
    _, offsets = bytes_of(batch.column(text))
    at = 0
    while at < n:
        to = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1), at + CHUNK_ROWS)
        yield batch.slice(at, to - at)
        at = to


def _spans(buffer: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words; a word never crosses a border (sorted offsets inside the buffer)."""
    inside = np.empty(len(buffer) + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(_SPACE[buffer], out=inside[1:-1])
    start = np.flatnonzero(inside[1:-1] & ~inside[:-2])
    end = np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    cut = border[inside[border] & inside[border + 1]]
    if len(cut):
        start, end = np.sort(np.concatenate([start, cut])), np.sort(np.concatenate([end, cut]))
    return start, end


def _hashes(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(buffer)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUES[buffer] * powers(_BASE, n), out=total[1:])
        value = (total[end] - total[start]) * powers(_INVERSE, n + 1)[start]
        value += (end - start).astype(np.uint64) * _U(0xC2B2AE3D27D4EB4F)
    return mix(value)


def words(texts: pa.Array, lower: bool) -> Words:
    """Maximal runs of bytes other than blank and 9..13, by row; ``lower`` folds A-Z first.

    A long buffer is hashed piece by piece, cut before words, so that only the words' own arrays grow with it.
    """
    buffer, offsets = bytes_of(texts)
    if lower:
        buffer = _LOWER[buffer]
    n = len(buffer)
    border = np.unique(offsets[(offsets > 0) & (offsets < n)])
    start, end = _spans(buffer, border)
    hashes = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + CHUNK_BYTES, "right")))
        low = start[at]
        hashes[at:to] = _hashes(buffer[low : end[to - 1]], start[at:to] - low, end[at:to] - low)
        at = to
    return Words(buffer, offsets, np.searchsorted(start, offsets).astype(np.int64), start, end, hashes)


_STEP = 0x9FB21C651E98DF25
_STEP_BACK = pow(_STEP, -1, 1 << 64)


def runs(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each k consecutive values: one less than k fewer than there are values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        weighted = mix(values, seed + 3) * powers(_STEP, len(values))
        np.cumsum(weighted, out=total[1:])
        return mix((total[k:] - total[:n]) * powers(_STEP_BACK, n), seed + 1)
