"""Scoring by the networks: the fast ways against the layers that training uses, each sequence once, in many tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators import autoencoder as ae
from tidelog.operators import lstm
from tidelog.operators import windows as win


def test_autoencoder_scorer_is_its_forward_pass():
    rng = np.random.default_rng(0)
    model = ae.Autoencoder()
    model.weights = [w + rng.normal(0, 0.05, w.shape) for w in model.weights]
    model.stats = [[rng.normal(0, 0.3, c), rng.uniform(0.5, 2, c)] for c in model.params.channels]
    for width in (4, 7, 20):
        x = rng.normal(size=(21, 1, 20, width))
        want = ((model.forward(x)[0].value - x) ** 2).mean(axis=(1, 2, 3))
        assert np.allclose(model.scorer(8)(x), want, rtol=1e-12) and np.allclose(model.errors(x), want, rtol=1e-12)
    assert len(model.errors(x[:0])) == 0


def test_lstm_scorer_is_its_forward_pass():
    rng = np.random.default_rng(0)
    model = lstm.LSTM(11, lstm.LSTMParams(16, 24))
    model.weights = [w * 3 for w in model.weights]
    x = rng.integers(0, 11, (70, 50))
    want, got = model.forward(x)[0], model.scorer(32)(x)
    assert got.dtype == np.float32 and np.allclose(got, want, atol=1e-4) and len(model.scorer()(x[:0])) == 0


def test_sequences_are_scored_once(spark, sf, monkeypatch):
    from tidelog.plans import catalog

    seen = spark.sparkContext.accumulator(0)

    def errors(sequences, model):
        def run(batches):
            for batch in batches:
                seen.add(len(batch))
                yield batch[["window_idx"]].assign(reconstruction_error=batch["window_idx"] * 0.5)

        return sequences.select("window_idx", "steps").mapInPandas(run, "window_idx long, reconstruction_error double")

    monkeypatch.setattr(ae, "errors", errors)
    assert seen.value == 0 and catalog.QUERIES["m1_m4_autoencoder"](spark, sf).count() == seen.value > 0


def test_neighbourhoods_make_many_blocks(spark):
    """A million rows: what follows the window over blocks ran in 16 tasks at most."""
    rows = spark.range(1_000_000).select(F.col("id").alias("pos"))
    assert win.with_blocks(rows, "pos", 50, 0).select("__block").distinct().count() > 200
