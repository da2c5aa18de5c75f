"""The two networks: gradients against finite differences, and learning of what can be learned."""

from __future__ import annotations

import numpy as np

from tidelog.operators import autoencoder as ae
from tidelog.operators import lstm


def test_lstm_gradients():
    model = lstm.LSTM(5, lstm.LSTMParams(embedding=3, hidden=4))
    model.weights = [w.astype(np.float64) for w in model.weights]
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 5, (6, 4)), rng.integers(0, 5, 6)
    _, grads = model.gradients(x, y)
    for i, w in enumerate(model.weights):
        for at in zip(*(rng.integers(0 if i else 1 if d == 0 else 0, n, 4) for d, n in enumerate(w.shape))):
            keep = w[at]
            w[at] = keep + 1e-5
            up = model.gradients(x, y)[0]
            w[at] = keep - 1e-5
            down = model.gradients(x, y)[0]
            w[at] = keep
            assert abs((up - down) / 2e-5 - grads[i][at]) < 1e-6


def test_lstm_learns_a_cycle(spark):
    rows = [(i, i, [(i + j) % 4 for j in range(5)], (i + 5) % 4) for i in range(400)]
    pairs = spark.createDataFrame(rows, "idx long, line_no long, context array<long>, target long")
    model = lstm.train(pairs, 4, lstm.LSTMParams(16, 16, epochs=6, rate=1e-2))
    got = lstm.infer_top_k(pairs, model, 1).collect()
    assert len(got) == 400 and np.mean([r.in_topk for r in got]) > 0.98
    assert all((r.before == 0.0) == r.in_topk for r in got)


def test_autoencoder_gradients():
    model = ae.Autoencoder(ae.AutoencoderParams(channels=(3, 3, 6)))
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3, 1, 9, 7))
    model.weights = [w + rng.normal(0, 0.1, w.shape) for w in model.weights]  # off the kinks of ReLU at 0

    def loss() -> float:
        model.stats = [[np.zeros(c), np.ones(c)] for c in (3, 3, 6)]
        return float(((model.forward(x, training=True)[0].value - x) ** 2).mean())

    out, w = model.forward(x, training=True)
    out.backward(2 * (out.value - x) / x.size)
    worst = 0
    for i, v in enumerate(model.weights):
        at = tuple(rng.integers(0, n) for n in v.shape)
        keep = v[at]
        v[at] = keep + 1e-6
        up = loss()
        v[at] = keep - 1e-6
        down = loss()
        v[at] = keep
        worst = max(worst, abs((up - down) / 2e-6 - w[i].grad[at]))
    assert worst < 1e-5


def test_autoencoder_samples_all_windows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ae.Autoencoder, "fit", lambda self, x: seen.append(x[:, 0, 0, 0].astype(int)) or {})
    rows = [(i, [[float(i)]]) for i in range(400)]
    ae.train(spark.createDataFrame(rows, "window_idx long, steps array<array<double>>"), ae.AutoencoderParams(sample=100))
    assert len(seen[0]) == 100 and list(seen[0]) == sorted(seen[0]) and seen[0].min() < 40 and seen[0].max() >= 360


def test_queries_train_with_the_default_parameters(spark, sf, monkeypatch):
    from tidelog.plans import catalog

    asked = []
    real_ae, real_lstm = ae.Autoencoder.__init__, lstm.LSTM.__init__
    monkeypatch.setattr(ae.Autoencoder, "__init__", lambda self, params=ae.AutoencoderParams(): asked.append(params) or real_ae(self, params))
    monkeypatch.setattr(lstm.LSTM, "__init__", lambda self, n, p: asked.append(p) or real_lstm(self, n, p))
    for name in ("m1_m4_autoencoder", "d1_lstm_top_k"):
        catalog.QUERIES[name](spark, sf)
    assert asked == [ae.AutoencoderParams(), lstm.LSTMParams()]


def test_autoencoder_tells_odd_windows(spark):
    rng = np.random.default_rng(0)
    base = np.sin(np.arange(20)[:, None] / 3 + np.arange(8)[None] / 2)
    normal = base + rng.normal(0, 0.05, (120, 20, 8))
    odd = rng.normal(0, 1.0, (10, 20, 8))
    rows = [(i, v.tolist()) for i, v in enumerate(normal)]
    schema = "window_idx long, steps array<array<double>>"
    model, losses = ae.train(spark.createDataFrame(rows, schema), ae.AutoencoderParams(epochs=12, rate=5e-3))
    assert losses["train"][-1] < 0.5 * losses["train"][0]
    both = spark.createDataFrame(rows[-20:] + [(1000 + i, v.tolist()) for i, v in enumerate(odd)], schema)
    got = {r.window_idx: r.reconstruction_error for r in ae.errors(both, model).collect()}
    assert min(e for i, e in got.items() if i >= 1000) > max(e for i, e in got.items() if i < 1000)
