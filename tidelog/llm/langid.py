"""Language identification (operator 6): a bidirectional gated recurrent network over bytes.

Two GRUs of ``HIDDEN`` units read windows of ``WINDOW`` bytes in both directions; a softmax over the
two states labels every byte; a document's probabilities are the mean over all of its bytes.  The
network is trained in numpy by backpropagation through time on windows of at most ``SAMPLE`` labelled
rows (chosen by a hash of doc_id; the bound is a parameter).  Every byte of every text is labelled:
long texts are read window by window, each with fresh states.

The network knows no language but the trained ones, so its confidence can't tell that a text is in none of them.  What is rejected
follows from labelled rows held out of what judges them: a text is *stray* where its letter pairs, each under the language that the
network gives the byte, are less likely than those of held-out texts of as many different pairs (a single language has such a bound too), and *undecided*
where the best language leads the next by no more than a margin up to which held-out predictions are wrong as often as right.

Defined cases: a null or empty text has no prediction and is rejected; a text without letters (white space, digits, ASCII symbols), a stray
and an undecided one keep their prediction and are rejected; a language of one labelled row has no bound for strays; where the table has no labelled row
with text nothing can be learned, predictions are null and texts with letters are accepted;
repeated rows are judged alike; extra columns are ignored by :func:`identify` and kept by :func:`keep_accepted`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .sampling import bounded

HIDDEN, WINDOW, SAMPLE = 8, 256, 2000
#: Parts that take turns at being held out; deviations that are never stray; the share of held-out rows within the bound.
FOLDS, DEVIATIONS, WITHIN = 5, 5.0, 0.99
TRAIN_WINDOW, TRAIN_LANES, TRAIN_STEPS, RATE = 48, 192, 120, 0.03
SCHEMA = "doc_id long, lang_pred string, confidence double, accepted boolean, probabilities array<float>, position_labels binary"
f32 = np.float32
#: Letters without case, bytes of other scripts as they are, 0 for all else.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], dtype=np.uint8)


@dataclass
class Typical:
    """Log-likelihoods of letter pairs by language, and how held-out texts have them."""

    pairs: np.ndarray  # (languages, 65536)
    mean: np.ndarray  # of a text's mean log-likelihood; then its variance between texts, and between the pairs of a text
    between: np.ndarray
    inside: np.ndarray
    bound: np.ndarray  # deviations under the mean beyond which a text is stray


@dataclass
class Model:
    languages: list[str]
    forward: tuple[np.ndarray, np.ndarray]  # input table (256, 3h) and recurrent weights (h, 3h)
    backward: tuple[np.ndarray, np.ndarray]
    out: np.ndarray  # (2h, languages)
    bias: np.ndarray
    typical: Typical | None = None
    margin: float = 0.0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += f32(1)
    return np.reciprocal(x, out=x)


def _step(x: np.ndarray, state: np.ndarray, weights: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    gates = state @ weights[:, : 2 * h]
    gates += x[:, : 2 * h]
    _sigmoid(gates)
    new = (gates[:, h:] * state) @ weights[:, 2 * h :]
    new += x[:, 2 * h :]
    np.tanh(new, out=new)
    nxt = new - state
    nxt *= gates[:, :h]
    nxt += state
    return nxt, gates, new


def states(codes: np.ndarray, active: np.ndarray, table: np.ndarray, weights: np.ndarray, reverse: bool) -> np.ndarray:
    """States (time, lanes, h); at time t the first ``active[t]`` lanes have a byte."""
    steps, lanes = codes.shape
    h = weights.shape[0]
    every = np.zeros((steps, lanes, h), dtype=f32)
    state = np.zeros((lanes, h), dtype=f32)
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        m = active[t]
        if m:
            every[t, :m] = state[:m] = _step(table.take(codes[t, :m], axis=0), state[:m], weights, h)[0]
    return every


def _softmax(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=-1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=-1, keepdims=True)
    return x


def byte_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(bytes, languages): the label probabilities of every byte of the rows."""
    size = np.diff(offsets)
    n = -(-size // WINDOW)
    inner = tx.ranges(np.zeros(len(n), dtype=np.int64), n)
    start = np.repeat(offsets[:-1], n) + WINDOW * inner
    length = np.minimum(WINDOW, np.repeat(offsets[1:], n) - start)
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    out = np.empty((len(data), len(model.languages)), dtype=f32)
    if not len(start):
        return out
    lanes = 2048
    for low in range(0, len(start), lanes):
        s, ln = start[low : low + lanes], length[low : low + lanes]
        time = np.arange(int(ln[0]))
        at = np.minimum(s[None, :] + time[:, None], len(data) - 1)
        codes = data[at]
        active = np.searchsorted(-ln, -(time + 1), side="right")
        ahead = states(codes, active, *model.forward, reverse=False)
        behind = states(codes, active, *model.backward, reverse=True)
        h = ahead.shape[2]
        p = _softmax(ahead @ model.out[:h] + behind @ model.out[h:] + model.bias)
        there = ln[None, :] > time[:, None]
        out[at[there]] = p[there]
    return out


def train(texts: list[str], languages: list[str], seed: int = 7) -> Model:
    """Fit the network by backpropagation through time with Adam."""
    names = sorted(set(languages))
    rng = np.random.default_rng(seed)
    h, c = HIDDEN, len(names)
    scale = 1 / np.sqrt(h)
    params = [a.astype(f32) for d in range(2) for a in (rng.normal(0, 0.5, (256, 3 * h)), rng.normal(0, scale, (h, 3 * h)))]
    params += [rng.normal(0, scale, (2 * h, c)).astype(f32), np.zeros(c, dtype=f32)]
    every = [[t for t, g in zip(texts, languages, strict=True) if g == name] for name in names]
    held = [(t, k) for k, group in enumerate(every) for t in group[FOLDS - 1 :: FOLDS]]
    by = [[np.frombuffer(t.encode(), dtype=np.uint8) for i, t in enumerate(group) if i % FOLDS != FOLDS - 1] for group in every]
    by = [[np.resize(b, max(len(b), TRAIN_WINDOW)) for b in group if len(b)] for group in by]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, TRAIN_STEPS + 1):
        label = rng.integers(0, c, TRAIN_LANES)
        rows = []
        for k in label:
            b = by[k][rng.integers(0, len(by[k]))]
            at = rng.integers(0, len(b) - TRAIN_WINDOW + 1)
            rows.append(b[at : at + TRAIN_WINDOW])
        grads = _gradients(params, np.stack(rows, axis=1), label)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / TRAIN_STEPS))
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            params[i] -= (rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-6)).astype(f32)
    model = Model(names, (params[0], params[1]), (params[2], params[3]), params[4], params[5], typical([[t.encode() for t in group] for group in every]))
    if held:
        data, offsets = tx.text_buffer(pa.array([t for t, _ in held]))
        pooled = _pooled(byte_probabilities(model, data, offsets), offsets)
        model.margin = undecided(_lead(pooled), pooled.argmax(axis=1) == np.array([k for _, k in held]))
    return model


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, pair): the letter pairs of all rows, by the place of their second byte; a run of anything else is one blank.  And which bytes are letters."""
    codes = LETTERS[data]
    capital = 1 + np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E))  # of Latin-1
    codes[capital] += 0x20
    before = np.concatenate([np.zeros(min(1, len(codes)), np.uint8), codes[:-1]])
    before[offsets[:-1][np.diff(offsets) > 0]] = 0
    place = np.flatnonzero((codes > 0) | (before > 0))
    return place, before[place].astype(np.int32) * 256 + codes[place], codes > 0


def _likelihoods(counts: np.ndarray) -> np.ndarray:
    """Log-likelihood of a letter after another: pairs, smoothed by single letters, and those by any byte."""
    table = counts.reshape(256, 256)
    single = 0.99 * table.sum(axis=0) / max(table.sum(), 1) + 0.01 / 256
    return np.log(0.8 * table / np.maximum(table.sum(axis=1, keepdims=True), 1) + 0.2 * single).ravel()


def deviation(between: np.ndarray, inside: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Of a text with ``kinds`` different pairs; the second term is that of Bernstein's bound, since few pairs have skewed means."""
    return np.sqrt(between + inside / kinds) + np.sqrt(inside) * DEVIATIONS / (3 * kinds)


def typical(groups: list[list[bytes]]) -> Typical:
    """Tables from all texts of each language; bounds from every text under the tables of the other folds."""
    c = len(groups)
    out = Typical(np.zeros((c, 1 << 16), f32), np.zeros(c), np.zeros(c), np.ones(c), np.full(c, np.inf))
    for k, group in enumerate(groups):
        rows = [_pairs(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[1] for t in group]
        folds = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int32), *rows[i::FOLDS]]), minlength=1 << 16) for i in range(FOLDS)])
        total = folds.sum(axis=0)
        out.pairs[k] = _likelihoods(total)
        tables = [_likelihoods(total - f) for f in folds]
        scores = [tables[i % FOLDS][r] for i, r in enumerate(rows) if len(r)]
        if len(scores) < 2:
            continue
        kinds, mean = np.array([len(np.unique(r)) for r in rows if len(r)]), np.array([s.mean() for s in scores])
        out.mean[k] = np.median(mean)
        out.between[k] = (1.4826 * np.median(np.abs(mean - out.mean[k]))) ** 2
        out.inside[k] = max(sum(s.var() * len(s) for s in scores) / sum(map(len, scores)), 1e-6)
        out.bound[k] = max(DEVIATIONS, np.quantile((out.mean[k] - mean) / deviation(out.between[k], out.inside[k], kinds), WITHIN))
    return out


def undecided(lead: np.ndarray, right: np.ndarray) -> float:
    """The greatest lead such that predictions of no more than that are wrong at least as often as right; 0 if there is none."""
    order = np.argsort(lead, kind="stable")
    wrong = np.cumsum(~right[order]) >= np.arange(1, len(lead) + 1) / 2
    return float(lead[order][np.flatnonzero(wrong)[-1]]) if wrong.any() else 0.0


def _pooled(p: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(p) + 1, p.shape[1]))
    np.cumsum(p, axis=0, out=sums[1:], dtype=np.float64)
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)[:, None]


def _lead(pooled: np.ndarray) -> np.ndarray:
    """By how much the best language leads the next."""
    two = np.sort(pooled, axis=1)[:, -2:]
    return two[:, -1] - two[:, 0] if two.shape[1] > 1 else two[:, 0]


def _told(model: Model, data: np.ndarray, offsets: np.ndarray, labels: np.ndarray, pooled: np.ndarray) -> np.ndarray:
    """Rows with letters that are neither stray nor undecided."""
    t = model.typical
    place, pair, letter = _pairs(data, offsets)
    by = labels[place]
    row = np.repeat(np.arange(len(pooled)), np.diff(offsets))[place]
    add = lambda w=None: np.bincount(row, weights=w, minlength=len(pooled))
    n = np.maximum(add(), 1)
    under = add(t.mean[by] - t.pairs[by, pair]) / n
    share = np.stack([add(by == k) for k in range(len(model.languages))], axis=1) / n[:, None]
    free = (share @ np.isinf(t.bound)) > 0.5
    most = share @ np.where(np.isinf(t.bound), 0, t.bound) / np.maximum(share @ np.isfinite(t.bound), 1e-9)
    allowed = lambda kinds: most * deviation(share @ t.between, share @ t.inside, kinds)
    near = under <= allowed(n)
    far = np.flatnonzero(~near)
    if len(far):  # a pair that a text repeats counts once; that only widens what is allowed, so only these are counted
        inside = np.isin(row, far)
        kinds = n.copy()
        kinds[far] = np.maximum(np.bincount(np.unique(row[inside] * 65536 + pair[inside]) >> 16, minlength=len(n))[far], 1)
        near = under <= allowed(kinds)
    return _lettered(letter, offsets) & (near | free) & (_lead(pooled) > model.margin)


def _lettered(letter: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(letter)])
    return sums[offsets[1:]] > sums[offsets[:-1]]


def _gradients(params: list[np.ndarray], codes: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    steps, lanes = codes.shape
    out, bias = params[4], params[5]
    h, c = params[1].shape[0], len(bias)
    kept, tops = [], []
    for d in range(2):
        table, weights = params[2 * d], params[2 * d + 1]
        state, trace, top = np.zeros((lanes, h), dtype=f32), [], np.zeros((steps, lanes, h), dtype=f32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            nxt, gates, new = _step(table[codes[t]], state, weights, h)
            trace.append((t, state, gates, new))
            state = top[t] = nxt
        kept.append(trace)
        tops.append(top)
    p = _softmax(tops[0] @ out[:h] + tops[1] @ out[h:] + bias)
    p[:, np.arange(lanes), label] -= 1
    p /= steps * lanes
    flat = p.reshape(-1, c)
    d_out = np.concatenate([tops[d].reshape(-1, h).T @ flat for d in range(2)])
    grads: list[np.ndarray] = []
    for d in range(2):
        weights = params[2 * d + 1]
        d_top = p @ out[d * h : (d + 1) * h].T
        d_weights, d_inputs = np.zeros_like(weights), np.zeros((steps, lanes, 3 * h), dtype=f32)
        carry = np.zeros((lanes, h), dtype=f32)
        for t, state, gates, new in reversed(kept[d]):
            g = d_top[t] + carry
            z, r = gates[:, :h], gates[:, h:]
            d_new = g * z * (1 - new * new)
            d_z = g * (new - state) * z * (1 - z)
            back = d_new @ weights[:, 2 * h :].T
            d_r = back * state * r * (1 - r)
            d_gates = np.concatenate([d_z, d_r], axis=1)
            carry = g * (1 - z) + back * r + d_gates @ weights[:, : 2 * h].T
            d_weights[:, : 2 * h] += state.T @ d_gates
            d_weights[:, 2 * h :] += (r * state).T @ d_new
            d_inputs[t, :, : 2 * h], d_inputs[t, :, 2 * h :] = d_gates, d_new
        columns = d_inputs.reshape(-1, 3 * h)
        d_table = np.stack([np.bincount(codes.ravel(), weights=columns[:, j], minlength=256) for j in range(3 * h)], axis=1)
        grads += [d_table.astype(f32), d_weights]
    return [*grads, d_out, flat.sum(axis=0)]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Train on at most ``sample`` labelled rows with text, chosen by a hash of their doc_id, in an order of their own: the model
    doesn't depend on how the table is stored."""
    labelled = docs.where("lang is not null and length(text) > 0").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    rows = bounded(labelled, sample, "doc_id").collect()
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def judge(model: Model | None, column: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]:
    data, offsets = tx.text_buffer(column)
    size = np.diff(offsets)
    has = size > 0
    none = pa.array(~has)
    if model is None:
        void = pa.nulls(len(column), pa.string())
        return void, pa.nulls(len(column), pa.float64()), pa.array(_lettered(LETTERS[data] > 0, offsets)), pa.nulls(len(column), pa.list_(pa.float32())), pa.nulls(len(column), pa.binary())
    p = byte_probabilities(model, data, offsets)
    pooled = _pooled(p, offsets)
    best = pooled.argmax(axis=1)
    top = pooled[np.arange(len(best)), best]
    language = pa.array(np.asarray(model.languages, dtype=object)[best], mask=~has)
    labels = p.argmax(axis=1).astype(np.uint8)
    lists = tx.list_array(pooled.astype(f32).ravel(), np.full(len(size), p.shape[1]))
    return language, pa.array(top, mask=~has), pa.array(_told(model, data, offsets, labels, pooled)), pa.compute.if_else(none, pa.scalar(None, lists.type), lists), tx.binary_array(labels, size)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: language, confidence, whether it is accepted, and the label of every byte
    (an index into the sorted languages)."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, 1):
            yield pa.record_batch([batch.column(0), *judge(model, batch.column(1))], names=["doc_id", "lang_pred", "confidence", "accepted", "probabilities", "position_labels"])

    return tx.map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


def keep_accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``docs`` without the documents whose text is rejected; all columns stay."""
    model = model or fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.batches_of(batches, at):
            yield batch.filter(judge(model, batch.column(at))[2])

    return tx.map_batches(docs, run, docs.schema)
