"""Vectorised views of UTF-8 text columns: words, 64-bit word hashes and n-gram hashes.

A *word* is a maximal run of bytes that are not ASCII white space.  All kernels see whole texts;
they are fed slices of whole rows that hold about ``SLICE_BYTES`` of text, so the memory of a
worker does not depend on the size of an Arrow batch (a single longer text is a slice by itself).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
U64 = np.uint64
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (avalanche)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


BYTE_CODES = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown when needed and kept by the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, SLICE_BYTES + (1 << 17)), base & (2**64 - 1), dtype=U64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps, dtype=U64)
    return have[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string or binary column; a null reads as an empty text."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        width = np.int64
    elif pa.types.is_string(column.type) or pa.types.is_binary(column.type):
        width = np.int32
    else:
        column, width = column.cast(pa.string()), np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes of text each."""
    _, offsets = text_buffer(column)
    low, n = 0, len(column)
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def batches_of(batches: Iterator[pa.RecordBatch], text: int | str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text."""
    for batch in batches:
        for low, high in slices(batch.column(text), limit):
            yield batch.slice(low, high - low)


#: rows and bytes of an Arrow batch at most: a worker and its executor hold several at a time
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` over batches of bounded size (a setting of the session)."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


class Words:
    """Words of a slice: byte ``start``/``end`` of each, and ``first[d]``, the number of the first word of row d."""

    def __init__(self, column: pa.Array):
        self.data, self.offsets = text_buffer(column)
        n = len(self.data)
        inside = ~WHITE[self.data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends = inside
        ends = ends.copy()
        ends[:-1] &= ~inside[1:] | edge[1:n]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, self.offsets)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Row number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts())

    def hashes(self, codes: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word that depends on its bytes only (``codes``: one code per byte of the slice)."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum((BYTE_CODES[self.data] if codes is None else codes) * powers(_BASE, n), out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * powers(_INVERSE, n + 1)[self.start])


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of words[i : i+k] for every i with a full window (polynomial of the word hashes)."""
    n = len(words)
    if n < k:
        return np.zeros(0, dtype=U64)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(words * powers(_BASE, n), out=sums[1:])
    return mix((sums[k:] - sums[: n - k + 1]) * powers(_INVERSE, n + 1)[: n - k + 1])


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + l)."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    base = np.repeat(np.asarray(starts, dtype=np.int64) - (np.cumsum(lengths) - lengths), lengths)
    return base + np.arange(total)


def list_array(values: pa.Array | np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values if isinstance(values, pa.Array) else pa.array(values))


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    data = np.ascontiguousarray(data, dtype=np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
