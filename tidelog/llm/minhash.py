"""MinHash near-duplicate groups (operator 10).

One-permutation hashing: each shingle (``SHINGLE`` normalised words) is hashed once; the top bits
choose one of ``BINS`` bins and the smallest remaining value of each bin is kept.  An empty bin takes
the value of the first non-empty bin in a random order of its own (optimal densification: which donor
is taken depends on the empty bin, never on the document).  The signature is cut into ``BANDS`` bands;
documents that agree on a band share a bucket.  A bucket of n documents gives n - 1 edges from its
smallest document (a star), so pairs grow with the documents and not with the squares of groups.  Edges
whose signatures agree in fewer than ``THRESHOLD`` of the bins are dropped; groups are the connected
components of the rest.  Of pairs whose shingle sets have a Jaccard similarity of 0.6 and more, 0.97 and more are found; under that the share
falls, to 0.5 at 0.5.

A document is a doc_id with a text: node (d, h) with h the hash of the text, ordered by both.  Centres of buckets come from partial aggregates and a join,
so a bucket of very many documents is no task of its own until the join, where skewed partitions are split.

Defined cases: rows with a null doc_id, a null text or no word are never duplicates; equal rows are one document, and stay or go together; rows with
one doc_id and different texts are different documents (each may stay or go; where one repeats another of the same id, doc_id equals keep_id);
texts of one word have that word as their only shingle; texts of any length are read whole; extra columns are
ignored by :func:`near_duplicates` and kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written

BINS, BANDS, SHINGLE, THRESHOLD = 128, 32, 2, 0.5
BROADCAST_IDS = 1 << 20
NODE = "struct<d: long, h: long>"
EMPTY = np.uint32(0xFFFFFFFF)
ORDERS = np.stack([np.random.default_rng(1000 + k).permutation(BINS) for k in range(BINS)])


def _codes(data: np.ndarray) -> np.ndarray:
    """Byte codes that ignore case and the punctuation of sentences."""
    byte = np.arange(256)
    lower = np.where((byte >= 65) & (byte <= 90), byte + 32, byte)
    table = tx.BYTE_CODES[lower].copy()
    table[np.frombuffer(b".,;:!?'\"()", dtype=np.uint8)] = 0
    codes = table[data]
    if len(data) > 1:  # capital letters of Latin-1: C3 80..9E -> C3 A0..BE
        capital = 1 + np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))
        codes[capital] = table[data[capital] + 0x20]
    return codes


def shingles(column: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every shingle; a text of fewer than ``size`` words has one, all of its words."""
    words = tx.Words(column)
    h, counts, first = words.hashes(_codes(words.data)), words.counts(), words.first
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), n)
    at = tx.ranges(first[:-1], n)
    value = np.zeros(len(at), dtype=np.uint64)
    for j in range(size):
        there = at + j < first[1:][rows]
        value = value * np.uint64(0x9E3779B97F4A7C15) + np.where(there, h[np.minimum(at + j, max(len(h) - 1, 0))] if len(h) else 0, np.uint64(0))
    return rows, tx.mix(value)


def signatures(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Densified signatures (rows x BINS, uint32) and which rows have one."""
    rows, value = shingles(column)
    sig = np.full(len(column) * BINS, EMPTY, dtype=np.uint32)
    low = np.minimum((value >> np.uint64(20)).astype(np.uint32), EMPTY - np.uint32(1))
    np.minimum.at(sig, rows * BINS + (value >> np.uint64(57)).astype(np.int64), low)
    sig = sig.reshape(-1, BINS)
    has = (sig != EMPTY).any(axis=1)
    return densify(sig, has), has


def densify(sig: np.ndarray, has: np.ndarray) -> np.ndarray:
    out = sig.copy()
    row, col = np.nonzero((sig == EMPTY) & has[:, None])
    for step in range(BINS):
        if not len(row):
            break
        if step == 6:  # few donors: look at the whole order at once
            for lo in range(0, len(row), 1 << 15):
                r, c = row[lo : lo + (1 << 15)], col[lo : lo + (1 << 15)]
                donors = sig[r[:, None], ORDERS[c]]
                out[r, c] = donors[np.arange(len(r)), (donors != EMPTY).argmax(axis=1)]
            break
        donor = sig[row, ORDERS[col, step]]
        found = donor != EMPTY
        out[row[found], col[found]] = donor[found]
        row, col = row[~found], col[~found]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    parts = sig.reshape(len(sig), BANDS, BINS // BANDS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(parts.shape[2]):
        key = tx.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.batches_of(batches, 1):
        sig, has = signatures(batch.column(1))
        keep = np.flatnonzero(has)
        sig = np.ascontiguousarray(sig[keep])
        keys = band_keys(sig)
        yield pa.record_batch(
            [
                batch.column(0).take(pa.array(keep)),
                tx.list_array(keys.ravel(), np.full(len(keep), BANDS)),
                tx.binary_array(sig.view(np.uint8).ravel(), np.full(len(keep), 4 * BINS)),
            ],
            names=["id", "bands", "sig"],
        )


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = (tx.text_buffer(batch.column(i))[0].view(np.uint32).reshape(-1, BINS) for i in (2, 3))
        keep = pa.array((a == b).mean(axis=1) >= THRESHOLD)
        yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def candidate_edges(signed: DataFrame) -> DataFrame:
    """Star edges (a, b), a < b: each bucket's smallest document with every other one of the bucket."""
    bucket = signed.select("id", F.explode("bands").alias("key"))
    centre = bucket.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a < z").select("key", "a")
    return bucket.join(centre, "key").where("a < id").select("a", F.col("id").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, label) for every node of an edge; label is the smallest node of its connected component.

    Labels fall to the smallest neighbour and then to the label's own label (pointer jumping), so
    rounds grow with the logarithm of the longest chain; each round is a written table.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))), "edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "id").select("id", F.least("label", "near").alias("low"), F.col("label").alias("old"))
        up = labels.select(F.col("id").alias("low"), F.col("label").alias("up"))
        moved = written(lower.join(up, "low").select("id", F.least("low", "up").alias("label"), "old"), "labels")
        changed = moved.where("label < old").limit(1).count()
        labels = moved.select("id", "label")
        if not changed:
            return labels


def repeats(docs: DataFrame) -> DataFrame:
    """(id, label): every document (as a node) that repeats another, with the smallest one of its group, which stays."""
    node = F.struct(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"))
    source = docs.where("doc_id is not null and text is not null").select(node.alias("id"), "text").where("id.d is not null")
    signed = written(tx.map_batches(source, _sign, f"id {NODE}, bands array<long>, sig binary"), "signatures")
    edges = candidate_edges(signed)
    sig = signed.select("id", "sig")
    pairs = edges.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
    near = tx.map_batches(pairs.select("a", "b", "sa", "sb"), _agreement, f"a {NODE}, b {NODE}").distinct()
    return components(near).where("label < id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id): every document that repeats another, with the doc_id of the one of its group that stays."""
    return repeats(docs).select(F.col("id.d").alias("doc_id"), F.col("label.d").alias("keep_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` without the documents that repeat another; all columns stay.

    Up to ``BROADCAST_IDS`` documents (counted first) are broadcast, so that texts stay where they are; more are joined by shuffling.
    """
    gone = written(repeats(docs).select(F.col("id.d").alias("__gone_d"), F.col("id.h").alias("__gone_h")), "gone")
    few = gone.count() <= BROADCAST_IDS
    same = (docs["doc_id"].cast("long") == gone["__gone_d"]) & (F.xxhash64(docs["text"]) == gone["__gone_h"])
    return docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
