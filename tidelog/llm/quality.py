"""Quality by pairwise ranking (operator 7): a Bradley-Terry model over text features.

Of two documents, the one labelled good is preferred to the one labelled bad with probability
sigmoid(score(good) - score(bad)).  The score is linear in ``FEATURES``; the logistic loss on feature
differences of up to ``PAIRS`` preference pairs is minimised by Newton steps.  Pairs come from at
most ``SAMPLE`` labelled documents (chosen by a hash of doc_id; a parameter).  Every document is then
scored over its whole text, and those whose score is under the corpus quantile ``QUANTILE`` are marked not to
be kept.  The quantile is exact on scores rounded to ``GRID``: counts per grid step over all documents, so nothing
is sampled or gathered but one row per step that occurs.

Defined cases: null and empty texts have no score and aren't kept; a text of white space only has words, marks and letters of share 0 and the score of
such features; texts of any length are read whole; a row with a null doc_id is scored like any other and never a training row; rows on the quantile (ties) are all kept; where labels hold no pair of both
kinds with text, scores are null and every other document is kept; repeated rows get equal scores; extra columns
are ignored by :func:`scored` and kept by :func:`keep_good`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as tx
from .sampling import bounded
from .scratch import written

FEATURES = ("log_words", "mean_word", "upper", "digit", "symbol", "mark", "stop", "repeat_word", "distinct", "repeat_line", "short_word", "long_word")
SAMPLE, PAIRS, QUANTILE, GRID, RIDGE = 4000, 40_000, 0.1, 0.01, 1.0
SCHEMA = "doc_id long, score double"

_BYTE = np.arange(256)
_KIND = {
    "upper": (_BYTE >= 65) & (_BYTE <= 90),
    "digit": (_BYTE >= 48) & (_BYTE <= 57),
    "symbol": np.isin(_BYTE, list(b"#$%&*+/<=>@\\^_`{|}~[]")),
    "mark": np.isin(_BYTE, list(b"!?:;\"()-")),
    "stop": np.isin(_BYTE, list(b".,")),
}


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(column: pa.Array) -> np.ndarray:
    """(rows, features); a row without words is all zeros."""
    words = tx.Words(column)
    data, offsets, first = words.data, words.offsets, words.first
    n, size = words.counts(), np.maximum(np.diff(offsets), 1)
    h, row = words.hashes(), words.rows()
    width = words.end - words.start
    per = np.maximum(n, 1)
    out = np.zeros((len(n), len(FEATURES)))
    put = lambda name, x: out.__setitem__((slice(None), FEATURES.index(name)), x)
    put("log_words", np.log1p(n))
    put("mean_word", _sums(width, first) / per)
    for name, kind in _KIND.items():
        put(name, _sums(kind[data], offsets) / size)
    same = np.zeros(len(h))
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    put("repeat_word", _sums(same, first) / per)
    key = tx.mix(h ^ tx.mix(row.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    fresh = np.ones(len(key))
    fresh[order[1:]] = key[order[1:]] != key[order[:-1]]
    put("distinct", _sums(fresh, first) / np.sqrt(per))
    # lines: words between line ends; a line repeats if an equal one came before it in the text
    breaks = np.concatenate([[0], np.cumsum(data == 10)])
    line = np.flatnonzero(np.concatenate([[True], (breaks[words.start[1:]] != breaks[words.start[:-1]]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
    if len(line):
        place = np.arange(len(h), dtype=np.uint64) - np.repeat(line, np.diff(np.append(line, len(h)))).astype(np.uint64)
        lines = np.add.reduceat(tx.mix(h + place * np.uint64(0x9E3779B97F4A7C15)), line)
        key = tx.mix(lines ^ tx.mix(row[line].astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key))
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        put("repeat_line", np.bincount(row[line], weights=again, minlength=len(n)) / np.maximum(np.bincount(row[line], minlength=len(n)), 1))
    put("short_word", _sums(width <= 2, first) / per)
    put("long_word", _sums(width >= 15, first) / per)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6) @ self.weights


def train(x: np.ndarray, good: np.ndarray, seed: int = 11) -> Model | None:
    """Bradley-Terry weights from preference pairs of good over bad rows."""
    best, worst = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(best) or not len(worst):
        return None
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.clip((x - mean) / scale, -6, 6)
    if len(best) * len(worst) <= PAIRS:
        a, b = (p.ravel() for p in np.meshgrid(best, worst))
    else:
        a, b = rng.choice(best, PAIRS), rng.choice(worst, PAIRS)
    d = z[a] - z[b]
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        gradient = d.T @ (p - 1) + RIDGE * w
        hessian = (d * (p * (1 - p))[:, None]).T @ d + RIDGE * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` labelled documents."""
    chosen = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    chosen = bounded(chosen, sample, "doc_id")
    rows = docs.where("text is not null and length(text) > 0").select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, 1):
            x = features(batch.column(1))
            yield pa.record_batch([batch.column(0), batch.column(2), tx.list_array(x.ravel(), np.full(len(x), len(FEATURES)))], names=["doc_id", "quality", "x"])

    got = tx.map_batches(rows.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), run, "doc_id long, quality int, x array<double>").orderBy("doc_id", "quality", "x").collect()
    return train(np.array([r.x for r in got]), np.array([r.quality for r in got]) > 0) if got else None


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score), the score rounded to GRID; null for texts that are null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, 1):
            column = batch.column(1)
            empty = np.diff(tx.text_buffer(column)[1]) == 0
            yield pa.record_batch([batch.column(0), pa.array(np.round(model.score(features(column)) / GRID) * GRID + 0.0, mask=empty)], names=["doc_id", "score"])

    return tx.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def threshold(scored: DataFrame, quantile: float = QUANTILE) -> float | None:
    """The least score that at least ``quantile`` of the scored rows don't exceed, from counts per grid step."""
    counts = scored.where("score is not null").groupBy("score").agg(F.count("*").alias("n"))
    below = counts.select("score", F.sum("n").over(W.orderBy("score")).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    return below.where(F.col("upto") >= quantile * F.col("all")).agg(F.min("score")).first()[0]


def scored(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score, keep) of every row: kept are scores of at least the quantile."""
    model = fit(docs, labels, sample)
    if model is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("keep"))
    every = written(scores(docs, model), "scores")
    limit = threshold(every, quantile)
    return every.select("doc_id", "score", F.coalesce(F.col("score") >= F.lit(limit), F.lit(False)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, sample: int = SAMPLE) -> DataFrame:
    """``docs`` without the rows that aren't kept; all columns stay."""
    model = fit(docs, labels, sample)
    if model is None:
        return docs.where("length(text) > 0")
    limit = threshold(scores(docs, model), quantile)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, at):
            column = batch.column(at)
            full = np.diff(tx.text_buffer(column)[1]) > 0
            yield batch.filter(pa.array(full & (np.round(model.score(features(column)) / GRID) * GRID >= limit)))

    return tx.map_batches(docs, run, docs.schema)
