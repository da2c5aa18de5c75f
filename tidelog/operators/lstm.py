"""Next-template network: embedding, one LSTM layer, linear output, in numpy.

Trained on the driver on at most ``sample`` (context, target) pairs, scored in Arrow batches on the
executors.  Seeded: the same pairs give the same network.  Template 0 shares the padding slot, whose embedding stays 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LSTMParams:
    embedding: int = 64
    hidden: int = 128
    epochs: int = 3
    batch: int = 64
    rate: float = 1e-3
    sample: int = 20_000
    seed: int = 0


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class LSTM:
    def __init__(self, vocabulary: int, p: LSTMParams):
        rng = np.random.default_rng(p.seed)
        s = 1 / np.sqrt(p.hidden)
        u = lambda *shape: rng.uniform(-s, s, shape).astype(np.float32)
        self.hidden = p.hidden
        self.weights = [rng.normal(0, 1, (vocabulary, p.embedding)).astype(np.float32), u(p.embedding, 4 * p.hidden), u(p.hidden, 4 * p.hidden), u(4 * p.hidden), u(p.hidden, vocabulary), u(vocabulary)]
        self.weights[0][0] = 0

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """Logits of the last step for contexts (n, length), and what backward needs."""
        e, wx, wh, b, wo, bo = self.weights
        n, h = len(x), self.hidden
        state, cell, trace = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), []
        for t in range(x.shape[1]):
            a = e[x[:, t]]
            z = a @ wx + state @ wh + b
            i, f, g, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), np.tanh(z[:, 2 * h : 3 * h]), _sigmoid(z[:, 3 * h :])
            old, before = cell, state
            cell = f * old + i * g
            top = np.tanh(cell)
            state = o * top
            if keep:
                trace.append((x[:, t], a, i, f, g, o, old, top, before))
        return state @ wo + bo, [*trace, state] if keep else []

    def scorer(self, size: int = 256) -> Callable[[np.ndarray], np.ndarray]:
        """A function for the logits of :meth:`forward`, up to rounding: for few rows at a time, in place, the input's share of the gates read from a table."""
        e, wx, wh, b, wo, bo = self.weights
        h = self.hidden
        gates = np.r_[0 : 2 * h, 3 * h : 4 * h, 2 * h : 3 * h]  # the three sigmoids side by side
        sign = np.where(np.arange(4 * h) < 3 * h, -1, 1).astype(np.float32)  # a sigmoid is 1 / (1 + exp(-z))
        table, wh = (e @ wx + b)[:, gates] * sign, wh[:, gates] * sign

        def part(x: np.ndarray) -> np.ndarray:
            n = len(x)
            z, own = np.empty((n, 4 * h), np.float32), np.empty((n, 4 * h), np.float32)
            state, cell, s, g = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32), np.empty((n, 3 * h), np.float32), np.empty((n, h), np.float32)
            for words in np.ascontiguousarray(x.T):
                np.matmul(state, wh, out=z)
                z += np.take(table, words, axis=0, out=own, mode="clip")  # no bounds are checked
                np.exp(np.minimum(z[:, : 3 * h], 30, out=s), out=s)
                s += 1
                np.reciprocal(s, out=s)
                np.tanh(z[:, 3 * h :], out=g)
                g *= s[:, :h]
                cell *= s[:, h : 2 * h]
                cell += g
                np.tanh(cell, out=state)
                state *= s[:, 2 * h :]
            return state @ wo + bo

        return lambda x: np.concatenate([part(x[low : low + size]) for low in range(0, len(x), size)] + [np.zeros((0, len(bo)), np.float32)])

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
        logits, trace = self.forward(x, keep=True)
        e, wx, wh, _, wo, _ = self.weights
        logits = logits - logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        rows = np.arange(len(y))
        loss = float(-np.log(p[rows, y] + 1e-12).mean())
        p[rows, y] -= 1
        p /= len(y)
        grads = [np.zeros_like(w) for w in self.weights]
        grads[4], grads[5] = trace[-1].T @ p, p.sum(axis=0)
        dh, dc = p @ wo.T, np.zeros_like(trace[-1])
        for words, a, i, f, g, o, old, top, before in reversed(trace[:-1]):
            dc = dc + dh * o * (1 - top * top)
            dz = np.concatenate([dc * g * i * (1 - i), dc * old * f * (1 - f), dc * i * (1 - g * g), dh * top * o * (1 - o)], axis=1)
            grads[1] += a.T @ dz
            grads[2] += before.T @ dz
            grads[3] += dz.sum(axis=0)
            np.add.at(grads[0], words, dz @ wx.T)
            dh, dc = dz @ wh.T, dc * f
        grads[0][0] = 0
        return loss, grads


class Adam:
    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate, self.step = weights, rate, 0
        self.first, self.second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]

    def update(self, grads: list[np.ndarray]) -> None:
        self.step += 1
        for w, g, m, v in zip(self.weights, grads, self.first, self.second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w -= (self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)).astype(w.dtype)


def train(pairs: DataFrame, vocabulary: int, params: LSTMParams = LSTMParams()) -> LSTM:
    """``pairs``: (idx, context, target); at most ``params.sample`` of them, by a hash of idx."""
    n = pairs.count()
    chosen = pairs if n <= params.sample else pairs.where(F.pmod(F.xxhash64("idx"), F.lit(n)) < params.sample)
    rows = chosen.select("idx", "context", "target").limit(2 * params.sample).collect()
    rows = sorted(rows, key=lambda r: r.idx)[: params.sample]
    model = LSTM(vocabulary, params)
    if not rows:
        return model
    x, y = np.array([r.context for r in rows]), np.array([r.target for r in rows])
    adam, rng = Adam(model.weights, params.rate), np.random.default_rng(params.seed)
    for _ in range(params.epochs):
        order = rng.permutation(len(y))
        for low in range(0, len(y), params.batch):
            at = order[low : low + params.batch]
            adam.update(model.gradients(x[at], y[at])[1])
    return model


def infer_top_k(pairs: DataFrame, model: LSTM, k: int = 3) -> DataFrame:
    """(idx, line_no, target, in_topk, predicted, before): ``before`` is the probability ranked above the target, for top-p verdicts."""
    k = min(k, len(model.weights[5]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                x = part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                y = part.column(2).to_numpy()
                logits = score(x).astype(np.float64)
                p = np.exp(logits - logits.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                top = np.argsort(-p, axis=1, kind="stable")[:, :k]
                own = p[np.arange(len(y)), y][:, None]
                offsets = pa.array(np.arange(len(y) + 1, dtype=np.int32) * k)
                yield pa.record_batch(
                    [part.column(0), part.column(1), part.column(2), pa.array((top == y[:, None]).any(axis=1)), pa.ListArray.from_arrays(offsets, pa.array(top.ravel())), pa.array((p * (p > own)).sum(axis=1))],
                    names=["idx", "line_no", "target", "in_topk", "predicted", "before"],
                )

    return pairs.select("idx", "line_no", "target", "context").mapInArrow(run, "idx long, line_no long, target long, in_topk boolean, predicted array<long>, before double")
