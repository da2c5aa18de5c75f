"""Token IDs of documents, and their binary form: patched frame-of-reference blocks (operator 4).

Texts are encoded with a given byte-level BPE vocabulary (a path, read by each worker, never copied).
A document's IDs are cut into blocks of ``BLOCK``.  A block stores its minimum (4 bytes), a width (1)
and a number of exceptions (1), then the low ``width`` bits of each difference from the minimum, then
the exceptions: places (1 byte each) and the bits above (4 each).  The width is the bit length at
the ``PERCENTILE`` of the block's differences, so a few outliers don't widen all values.  The byte
where each block starts is the index: any block decodes by itself.

The regular expression that cuts texts into pieces backtracks over white space and fails on a million blanks in a row.
Texts are therefore cut beside runs of ``RUN`` and more, at places where it cuts anyway: the IDs are those of the uncut text.

Defined cases: white space of any length, and texts of any length, are encoded whole; a null text has null n_tokens, payload and index; an empty text has 0 tokens, an empty
payload and index; text that looks like a special token is ordinary text; rows with null or repeated
doc_id are encoded like any other; extra columns are ignored.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import tiktoken
from pyspark.sql import DataFrame

from . import text as tx

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK, PERCENTILE, HEADER = 128, 0.9, 6
RUN = 50_000
#: What \\s is in PATTERN (White_Space of Unicode; Python's own \\s has four control characters more).
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % RUN)
SCHEMA = "doc_id long, n_tokens long, payload binary, block_starts array<int>"


@lru_cache(maxsize=2)
def encoding(vocabulary: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as file:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, file)}
    return tiktoken.Encoding("byte-bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(coder: tiktoken.Encoding, text: str) -> list[int]:
    """IDs of one text.  Of a run of white space before other text, PATTERN takes all but the last character as one piece."""
    if len(text) < RUN:
        return coder.encode_ordinary(text)
    ids, done = [], 0
    for run in LONG_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += coder.encode_ordinary(text[done : run.start()])
        ids += coder._encode_single_piece(text[run.start() : end])
        done = end
    return ids + coder.encode_ordinary(text[done:])


def encode(column: pa.Array, vocabulary: str = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """IDs of all rows, joined, and the number of each row (a null has none)."""
    coder = encoding(vocabulary)
    rows = [np.array(ids_of(coder, t), dtype=np.uint32) if t else np.zeros(0, np.uint32) for t in column.to_pylist()]
    return np.concatenate([*rows, np.zeros(0, np.uint32)]), np.array([len(r) for r in rows], dtype=np.int64)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each value (0 for 0), exact for 32-bit values."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def pack(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all rows, bytes of each row, starts of all blocks (from their row's first byte), blocks of each row."""
    blocks = -(-counts // BLOCK)
    n = int(blocks.sum())
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(len(counts), np.int64), np.zeros(0, np.int32), blocks
    first = np.repeat(np.cumsum(counts) - counts, blocks) + BLOCK * tx.ranges(np.zeros(len(blocks), np.int64), blocks)
    size = np.minimum(BLOCK, np.repeat(np.cumsum(counts), blocks) - first)
    place = np.arange(BLOCK)
    there = place < size[:, None]
    values = ids[np.minimum(first[:, None] + place, len(ids) - 1)].astype(np.uint32)
    least = np.where(there, values, np.uint32(0xFFFFFFFF)).min(axis=1)
    values = np.where(there, values - least[:, None], np.uint32(0))
    bits = np.where(there, bit_length(values), 255).astype(np.uint8)
    bits.sort(axis=1)
    width = bits[np.arange(n), np.ceil(PERCENTILE * size).astype(np.int64) - 1].astype(np.int64)
    high = (values.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, col = np.nonzero(high)
    exceptions = np.bincount(row, minlength=n)
    packed = -(-size // 8) * width
    length = HEADER + packed + 5 * exceptions
    start = np.cumsum(length) - length
    out = np.zeros(int(length.sum()), dtype=np.uint8)
    out[start[:, None] + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[start + 4] = width
    out[start + 5] = exceptions
    for w in np.unique(width[width > 0]):
        every = np.flatnonzero(width == w)
        for low in range(0, len(every), 1 << 12):  # bits take a byte each while they are packed
            own = every[low : low + (1 << 12)]
            bit = ((values[own][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
            data = np.packbits(bit.reshape(len(own), -1), axis=1, bitorder="little")
            keep = np.arange(data.shape[1]) < packed[own][:, None]
            out[(start[own][:, None] + HEADER + np.arange(data.shape[1]))[keep]] = data[keep]
    order = np.arange(len(row)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = start[row] + HEADER + packed[row]
    out[at + order] = col
    out[(at + exceptions[row] + 4 * order)[:, None] + np.arange(4)] = high[row, col].astype("<u4").view(np.uint8).reshape(-1, 4)
    per_row = np.bincount(np.repeat(np.arange(len(counts)), blocks), weights=length, minlength=len(counts)).astype(np.int64)
    base = np.repeat(np.cumsum(per_row) - per_row, blocks)
    return out, per_row, (start - base).astype(np.int32), blocks


def unpack_block(payload: bytes, start: int, size: int) -> np.ndarray:
    """The ``size`` IDs of the block at byte ``start``."""
    least = int.from_bytes(payload[start : start + 4], "little")
    width, exceptions = payload[start + 4], payload[start + 5]
    at = start + HEADER
    packed = -(-size // 8) * width
    bits = np.unpackbits(np.frombuffer(payload, np.uint8, packed, at), bitorder="little").reshape(-1, width) if width else np.zeros((size, 0), np.uint8)
    values = (bits.astype(np.uint64) << np.arange(width, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)[:size]
    at += packed
    place = np.frombuffer(payload, np.uint8, exceptions, at)
    values[place] |= np.frombuffer(payload, "<u4", exceptions, at + exceptions).astype(np.uint64) << np.uint64(width)
    return (values + np.uint64(least)).astype(np.uint32)


def unpack(payload: bytes, starts: list[int], n_tokens: int) -> np.ndarray:
    """All IDs of a document."""
    parts = [unpack_block(payload, s, min(BLOCK, n_tokens - BLOCK * i)) for i, s in enumerate(starts)]
    return np.concatenate([*parts, np.zeros(0, np.uint32)])


def packed_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, payload, block_starts) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, 1):
            text = batch.column(1)
            ids, counts = encode(text, vocabulary)
            data, length, starts, blocks = pack(ids, counts)
            null = text.is_null()
            payload, index = tx.binary_array(data, length), tx.list_array(starts, blocks)
            columns = [pa.array(counts), payload, index]
            if text.null_count:
                columns = [pa.compute.if_else(null, pa.scalar(None, c.type), c) for c in columns]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", "n_tokens", "payload", "block_starts"])

    return tx.map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, SCHEMA)
