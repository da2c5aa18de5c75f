"""Where documents can share passages: the exact candidate step before the two substring operators.

A passage is a run of at least ``LENGTH`` words.  Every window of ``LENGTH`` words picks the smallest
hash among its ``GRAM``-word grams (winnowing), so two documents that share a window pick the same
*anchor* for it.  Anchors that occur in one document only can't lie in a shared window; the windows
of the others are the only text that is compared further.  Nothing is sampled: every shared window
is owned by an anchor that both documents have.

Each repeated anchor belongs to a *family*, the smallest doc_id that holds it.  A document
is sent to each family that it shares an anchor with, cut down to the windows of those anchors, so
all occurrences of a shared window meet in the family of its anchor, and data grow with what is
repeated.  Documents are ordered by (doc_id, hash of the text): a shared window stays in the first
document and repeats it in the others.  Rows with a null doc_id or text take no part; equal rows are
one document; shorter texts have no window.

A family is matched in one task.  In it, documents of equal text are one: all slices of the later ones repeat the first.  A family whose different texts
have more words than a task should hold (a passage in very many surroundings) is not gathered at all: its windows are hashed and compared by
aggregation, see :func:`split`.  Both ways give the same spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .scratch import written

LENGTH, GRAM = 50, 10
BROADCAST_CUTS = 1 << 20
SPANS = "doc_id long, text_hash long, start int, stop int"


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first and last window (word numbers) of each maximal run of windows of one text with the same anchor."""
    n = len(words) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    grams = tx.gram_hashes(words, GRAM)
    span = LENGTH - GRAM + 1
    low_bits = np.uint64(0xFFF)
    parts = []
    for c in range(0, n, 4000):  # in a part, positions fit the low bits: of equal grams the leftmost is chosen
        part = grams[c : c + 4000 + span - 1]
        least = (part & ~low_bits) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < span:
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        parts.append(c + (least & low_bits).astype(np.int64))
    at = np.concatenate(parts)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[edge]], edge, np.concatenate([edge[1:], [n]]) - 1


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.batches_of(batches, 2):
        words = tx.Words(batch.column(2))
        hashes = words.hashes()
        found = [anchors(hashes[a:b]) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        n = np.array([len(f[0]) for f in found])
        if n.sum() == 0:
            continue
        rows = pa.array(np.repeat(np.arange(len(n)), n))
        yield pa.record_batch(
            [
                pa.array(np.concatenate([f[0] for f in found]).view(np.int64)),
                batch.column(0).take(rows),
                batch.column(1).take(rows),
                pa.array(np.concatenate([f[1] for f in found]).astype(np.int32)),
                pa.array(np.concatenate([f[2] for f in found]).astype(np.int32)),
            ],
            names=["anchor", "doc_id", "text_hash", "low", "high"],
        )


def keyed(docs: DataFrame) -> DataFrame:
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return text.where("doc_id is not null and text is not null")


def repeated_anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, family, low, high) of every anchor that lies in several documents.  An anchor of very many is aggregated
    before it moves, and its partition of the join is split."""
    rows = tx.map_batches(keyed(docs), _anchor_rows, "anchor long, doc_id long, text_hash long, low int, high int")
    ends = rows.groupBy("anchor").agg(F.min("doc_id").alias("family"), F.max("doc_id").alias("last"), F.min("text_hash").alias("a"), F.max("text_hash").alias("b"))
    return rows.join(ends.where("family < last or a < b").select("anchor", "family"), "anchor").select("doc_id", "text_hash", "family", "low", "high")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text_hash, text, anchors) to one row for each family of the document: word hashes of the windows' text."""
    for batch in tx.batches_of(batches, 2):
        words = tx.Words(batch.column(2))
        hashes = words.hashes()
        lists = batch.column(3)
        flat = lists.flatten()
        family, low, high = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("family", "low", "high"))
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        order = np.lexsort((low, family, row))
        row, family, low, high = (x[order] for x in (row, family, low, high))
        if not len(row):
            continue
        head = np.ones(len(row), dtype=bool)
        head[1:] = (row[1:] != row[:-1]) | (family[1:] != family[:-1])
        head |= np.concatenate([[True], low[1:] > high[:-1] + 1])  # windows that follow each other are one slice
        first = np.flatnonzero(head)
        last = np.concatenate([first[1:], [len(row)]]) - 1
        begin, size = low[first].astype(np.int64), (high[last] - low[first]).astype(np.int64) + LENGTH
        owner = row[first]
        group = np.ones(len(first), dtype=bool)
        group[1:] = (owner[1:] != owner[:-1]) | (family[first][1:] != family[first][:-1])
        start = np.flatnonzero(group)
        n = np.diff(np.concatenate([start, [len(first)]]))
        text = hashes[tx.ranges(words.first[owner] + begin, size)]
        owners = pa.array(owner[start])
        yield pa.record_batch(
            [
                pa.array(family[first][start]),
                batch.column(0).take(owners),
                batch.column(1).take(owners),
                tx.list_array(begin.astype(np.int32), n),
                tx.list_array(size.astype(np.int32), n),
                tx.binary_array(text.view(np.uint8), 8 * np.add.reduceat(size, start)),
            ],
            names=["family", "doc_id", "text_hash", "begin", "size", "words"],
        )


def families(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The slices of each document for each of its families, one row each."""
    anchor = F.struct("family", "low", "high")
    per_doc = found.groupBy("doc_id", "text_hash").agg(F.collect_list(anchor).alias("anchors"))
    once = keyed(docs)
    cut = once.join(per_doc, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "anchors")
    return tx.map_batches(cut, _cut, "family long, doc_id long, text_hash long, begin array<int>, size array<int>, words binary")


@dataclass
class Slice:
    """Words ``begin .. begin + len(words)`` of document number ``doc`` of a family (numbers follow the documents' order)."""

    doc: int
    begin: int
    words: np.ndarray


@dataclass
class Family:
    keys: list[tuple[int, int]]
    slices: list[Slice]
    copies: list[tuple[int, int, int, int]]  # (doc_id, text_hash, start, stop): slices of documents whose text an earlier one has


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[Family]:
    """Families of a partition that is sorted by family and document; equal rows are one."""
    family, current, texts, last = None, Family([], [], []), set(), None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(3)]
        begins, sizes = batch.column(3), batch.column(4)
        data, offsets = tx.text_buffer(batch.column(5))
        b, s = begins.flatten().to_numpy(), sizes.flatten().to_numpy()
        parts = begins.offsets.to_numpy() - begins.offsets[0].as_py()
        for i, (of, doc, text_hash) in enumerate(zip(*columns, strict=True)):
            if of != family:
                if current.keys:
                    yield current
                family, current, texts, last = of, Family([], [], []), set(), None
            if last == (doc, text_hash):
                continue
            last = (doc, text_hash)
            if text_hash in texts:
                current.copies += [(doc, text_hash, int(b[j]), int(b[j] + s[j])) for j in range(parts[i], parts[i + 1])]
                continue
            texts.add(text_hash)
            current.keys.append(last)
            words = data[offsets[i] : offsets[i + 1]].copy().view(np.uint64)
            at = 0
            for j in range(parts[i], parts[i + 1]):
                current.slices.append(Slice(len(current.keys) - 1, int(b[j]), words[at : at + s[j]]))
                at += int(s[j])
    if current.keys:
        yield current


def split(cut: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of ``cut`` (a written table) of families of at most ``most`` words, and the spans of the other families, if there are any.

    A copy of a text adds nothing to the words of its family.
    """
    words = F.aggregate("size", F.lit(0).cast("long"), lambda n, x: n + x)
    texts = cut.groupBy("family", "text_hash").agg(F.max(words).alias("n"))
    hot = written(texts.groupBy("family").agg(F.sum("n").alias("n")).where(F.col("n") > most).drop("n"), "hot")
    n = hot.count()
    if not n:
        return cut, None
    hot = F.broadcast(hot) if n <= BROADCAST_CUTS else hot
    windows = tx.map_batches(cut.join(hot, "family", "left_semi").select("doc_id", "text_hash", "begin", "size", "words"), _windows, "window long, doc_id long, text_hash long, start int")
    key = F.struct("doc_id", "text_hash")
    known = windows.groupBy("window").agg(F.min(key).alias("first"), F.max(key).alias("last")).where("first < last").drop("last")
    again = windows.join(known, "window").where(key > F.col("first"))
    return cut.join(hot, "family", "left_anti"), again.select("doc_id", "text_hash", "start", (F.col("start") + LENGTH).alias("stop"))


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and first word of every window of the slices (windows of equal hash are of one family, that of their anchor)."""
    for batch in batches:
        begins, sizes = batch.column(2), batch.column(3)
        data, offsets = tx.text_buffer(batch.column(4))
        b, s = begins.flatten().to_numpy(), sizes.flatten().to_numpy()
        parts = begins.offsets.to_numpy() - begins.offsets[0].as_py()
        for i in range(batch.num_rows):
            text, size = data[offsets[i] : offsets[i + 1]].copy().view(np.uint64), s[parts[i] : parts[i + 1]].astype(np.int64)
            hashes = [tx.gram_hashes(part, LENGTH) for part in np.split(text, np.cumsum(size)[:-1])]
            row = pa.array(np.full(int((size - LENGTH + 1).sum()), i))
            start = tx.ranges(b[parts[i] : parts[i + 1]], size - LENGTH + 1).astype(np.int32)
            yield pa.record_batch([pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(row), batch.column(1).take(row), pa.array(start)], names=["window", "doc_id", "text_hash", "start"])


def matcher(find: Callable[[Iterator[Family]], Iterator[tuple[Family, list[tuple[int, int, int]]]]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over sorted families, the rows of SPANS; ``find`` yields each family with its spans (document number, start, stop)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for family, spans in find(grouped(batches)):
            rows = [(*family.keys[d], a, b) for d, a, b in spans] + family.copies
            if rows:
                doc, text_hash, start, stop = zip(*rows, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(text_hash, pa.int64()), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["doc_id", "text_hash", "start", "stop"])

    return run


def merged(spans: DataFrame) -> DataFrame:
    """Maximal spans: the union of overlapping and touching spans of a document."""
    by = W.partitionBy("doc_id", "text_hash").orderBy("start", "stop")
    before = F.max("stop").over(by.rowsBetween(W.unboundedPreceding, -1))
    new = spans.withColumn("new", F.when(before >= F.col("start"), 0).otherwise(1))
    island = new.withColumn("island", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return island.groupBy("doc_id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("island")


def result(spans: DataFrame) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): end_word is the last word of the span."""
    return spans.select("doc_id", F.col("start").cast("long").alias("start_word"), (F.col("stop") - 1).cast("long").alias("end_word"), (F.col("stop") - F.col("start")).cast("long").alias("n_words")).distinct()


def remove(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` without the words of ``spans``; ``n_chars``, if there, is counted anew.  All rows and columns stay.

    The spans of up to ``BROADCAST_CUTS`` spans (counted first) are broadcast, so that texts stay where they are; more are joined by shuffling.
    """
    spans = written(spans, "spans")
    cuts = spans.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__cuts"))
    cuts = F.broadcast(cuts) if spans.count() <= BROADCAST_CUTS else cuts
    on: Column = (docs["doc_id"].cast("long") == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash"))
    joined = docs.join(cuts, on, "left").drop("__id", "__hash")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, at):
            column, cuts = batch.column(at), batch.column(batch.num_columns - 1)
            changed = np.flatnonzero(cuts.is_valid().to_numpy(zero_copy_only=False))
            if len(changed):
                words, texts = tx.Words(column), column.to_pylist()
                starts = np.append(words.start, len(words.data))
                for i in changed:
                    base, stop_byte = int(words.first[i]), int(words.offsets[i + 1])
                    kept, at_byte = [], int(words.offsets[i])
                    for c in cuts[int(i)].as_py():
                        kept.append(words.data[at_byte : starts[base + c["start"]]])
                        at_byte = min(int(starts[base + c["stop"]]), stop_byte) if base + c["stop"] < words.first[i + 1] else stop_byte
                    kept.append(words.data[at_byte:stop_byte])
                    texts[i] = np.concatenate(kept).tobytes().decode()
                column = pa.array(texts, column.type)
            yield pa.record_batch([column if j == at else batch.column(j) for j in range(batch.num_columns - 1)], schema=pa.schema([batch.schema.field(j) for j in range(batch.num_columns - 1)]))

    clean = tx.map_batches(joined, run, docs.schema)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


#: DuckDB: words are runs of bytes that aren't ASCII white space; a window repeats if an earlier document has it.
ORACLE = f"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\\x09-\\x0d ]+'), lambda x: x <> '') AS ws FROM documents
           WHERE doc_id IS NOT NULL AND text IS NOT NULL),
g AS (SELECT doc_id, i, md5(array_to_string(ws[i + 1 : i + {LENGTH}], ' ')) AS gram
      FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {LENGTH - 1})) AS i FROM w WHERE len(ws) >= {LENGTH})),
f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
d AS (SELECT g.doc_id, g.i FROM g JOIN f USING (gram) WHERE g.doc_id > f.first_doc),
m AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {LENGTH} THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM m)
SELECT doc_id, min(i) AS start_word, max(i) + {LENGTH - 1} AS end_word, max(i) - min(i) + {LENGTH} AS n_words
FROM s GROUP BY doc_id, island
"""
