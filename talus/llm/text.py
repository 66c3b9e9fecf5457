"""Words of Arrow text columns as flat numpy arrays, used inside Spark tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def power_table(base: int, size: int) -> np.ndarray:
    """base^0 .. base^(size-1) modulo 2^64; kept and grown per worker."""
    table = _powers.get(base)
    if table is None or len(table) < size:
        table = np.full(max(size, SLICE_BYTES + 1), base, np.uint64)
        table[0] = 1
        table = _powers[base] = np.multiply.accumulate(table)
    return table[:size]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of several documents laid end to end.

    ``first`` has one entry more than there are documents: document d owns the
    words first[d] .. first[d+1]-1.
    """

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    def hashes(self) -> np.ndarray:
        """One 64-bit hash per word, of its bytes."""
        return span_hashes(self.data, self.start, self.end)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, from one running sum over the bytes."""
    weighted = (data.astype(np.uint64) + np.uint64(1)) * power_table(_BASE, len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(weighted, out=sums[1:])
    value = (sums[end] - sums[start]) * power_table(_BASE_INVERSE, len(data) + 1)[start]
    return mix64(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, values = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    low, high = offsets[0], offsets[-1]
    data = np.frombuffer(values, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8)
    return data, offsets - low


def split_words(column: pa.Array, lower: bool = False) -> Words:
    """Runs of bytes other than blank, tab, line feed, \\v, \\f and carriage return."""
    data, offsets = text_bytes(column)
    if lower:
        data = LOWER[data]
    inside = ~_SPACE[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]
    finish[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(begin), np.flatnonzero(finish) + 1
    doc = np.searchsorted(offsets, start, "right") - 1
    first = np.searchsorted(start, offsets)
    return Words(data, start, end, doc, first)


def shingle_hashes(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): word shingles of each document, in order.

    A document of fewer than ``size`` words, but at least one, has a single
    shingle of all its words.
    """
    h = words.hashes()
    counts = np.diff(words.first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=first[1:])
    place = np.arange(first[-1]) - np.repeat(first[:-1], n) + np.repeat(words.first[:-1], n)
    width = np.repeat(np.minimum(counts, size), n)
    padded = np.concatenate([h, np.zeros(size, np.uint64)])
    total = np.zeros(len(place), np.uint64)
    for k in range(size):
        term = padded[place + k]
        if k:
            term = np.where(width > k, term, np.uint64(0))
        total = total * np.uint64(0xA0761D6478BD642F) + term
    return mix64(total), first


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that every piece holds about ``limit`` bytes of text, at least one row."""
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    piece = (np.cumsum(sizes) // limit).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


def by_slices(fn: Callable[[pa.RecordBatch], pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES):
    """A mapInArrow function that applies ``fn`` to slices of bounded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, limit):
                yield fn(part)

    return run


def fold(doc_id: str, mod: int) -> Column:
    """crc32(doc_id as text) modulo ``mod``; a null id has fold null."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(mod)


def ragged_ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (length[0] of them), then start[1], ..."""
    total = int(length.sum())
    shift = np.repeat(start - (np.cumsum(length) - length), length)
    return shift + np.arange(total)
