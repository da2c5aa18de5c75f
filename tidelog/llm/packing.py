"""Packing by powers of two (operator 9).

A document of n tokens is cut, from its start, into as many pieces of ``LONGEST`` tokens as fit and
then into pieces whose lengths are the binary digits of the rest, longest first.  Every piece is a
training sequence by itself: none is padded, none crosses documents, and pieces of one length make up
one bucket, from which batches of equal shape are drawn.  Nothing is moved to cut; rows come out
bucket by bucket within each slice, and :func:`write_buckets` stores each bucket in a folder of its own.

Defined cases: null and empty texts have no piece; repeated rows (and ids) are each cut; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .tokens import VOCABULARY, encode

LONGEST = 8192
SCHEMA = "bucket int, doc_id long, piece int, start int, length int, tokens array<int>"


def pieces(counts: np.ndarray, longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray]:
    """Row and length of each piece, in the order of the text."""
    powers = longest >> np.arange(int(longest).bit_length())
    times = np.empty((len(counts), len(powers)), dtype=np.int64)
    times[:, 0] = counts // longest
    times[:, 1:] = (counts[:, None] // powers[1:]) & 1
    flat = times.ravel()
    return np.repeat(np.repeat(np.arange(len(counts)), len(powers)), flat), np.repeat(np.tile(powers, len(counts)), flat)


def packed(docs: DataFrame, vocabulary: str = VOCABULARY, longest: int = LONGEST) -> DataFrame:
    """(bucket, doc_id, piece, start, length, tokens): length is 2**bucket, start the piece's first token in its document."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, 1):
            ids, counts = encode(batch.column(1), vocabulary)
            row, length = pieces(counts, longest)
            at = np.cumsum(length) - length
            start = at - (np.cumsum(counts) - counts)[row]
            number = np.arange(len(row)) - np.searchsorted(row, row)
            order = np.argsort(length, kind="stable")
            tokens = ids[tx.ranges(at[order], length[order])].astype(np.int32)
            yield pa.record_batch(
                [
                    pa.array(np.log2(length[order]).astype(np.int32)),
                    batch.column(0).take(pa.array(row[order])),
                    pa.array(number[order].astype(np.int32)),
                    pa.array(start[order].astype(np.int32)),
                    pa.array(length[order].astype(np.int32)),
                    tx.list_array(tokens, length[order]),
                ],
                names=["bucket", "doc_id", "piece", "start", "length", "tokens"],
            )

    return tx.map_batches(docs.selectExpr("cast(doc_id as long) as doc_id", "text"), run, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Parquet with a folder for each bucket: a reader of one sequence length opens no other file."""
    pieces.write.partitionBy("bucket").parquet(path)
