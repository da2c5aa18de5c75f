"""Sessions, K-of-N and streams of few keys with very many rows: in blocks, against loops."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidelog.operators import sequence as seq
from tidelog.operators import windows as win


def test_sessions_and_k_of_n_across_blocks(spark, monkeypatch):
    """One host, null timestamps and a null host too; a window over a whole host or session isn't planned any more."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(win.with_blocks, "__defaults__", (16,))
    at = np.cumsum(rng.choice([1, 5, 400], 500, p=[0.6, 0.36, 0.04])).tolist()
    ok, host = (rng.random(500) < 0.35).tolist(), ["a" if x else None for x in rng.random(500) < 0.9]
    rows = [(i, None if i < 7 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=at[i]), host[i], ok[i]) for i in range(500)]
    df = spark.createDataFrame(rows, "line_no long, timestamp timestamp, host string, prediction_ok boolean").repartition(5)
    found = seq.k_of_n(seq.with_sessions(df, 300), 7, 10)
    got = {r.line_no: (r.session_no, r.k_of_n_triggered, list(r.recent_failures)) for r in found.collect()}
    state: dict = {}
    for i, t, h, fine in rows:
        last, number, recent = state.get(h, (None, 0, []))
        if last is not None and t is not None and (t - last).total_seconds() > 300:
            number, recent = number + 1, []
        recent = [*recent, not fine][-10:]
        assert got[i] == (number, len(recent) == 10 and sum(recent) >= 7 and not fine, recent)
        state[h] = (t, number, recent)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if " Window [" in line or line.startswith("Window [")]
    assert windows and all("__block" in w or "__m" in w or "__at" in w for w in windows)


class State:
    def __init__(self, value=None):
        self.value, self.exists = value, value is not None

    @property
    def get(self):
        return self.value

    def update(self, value):
        self.value, self.exists = value, True


def test_a_key_of_a_stream_leaves_in_slices():
    """500,000 rows of one key, unordered, with unknown templates: the whole key was one frame (Python's largest allocation was 3 times as high)."""
    import tracemalloc

    import pandas as pd

    from tidelog.streaming import scorer

    rng = np.random.default_rng(6)
    n, start = 500_000, np.datetime64("2024-01-01", "ns")
    line = rng.permutation(n)
    frame = pd.DataFrame({"key": "k", "line_no": line, "timestamp": start + (line // 3 * 1_000_000).astype("timedelta64[ns]"), "template_index": np.where(line % 7, line % 5, np.nan)})
    frame.loc[frame["line_no"] < 4, "timestamp"] = pd.NaT
    state, most, got = State(([8, 9], 5)), 0, []
    tracemalloc.start()
    base = tracemalloc.get_traced_memory()[0]
    for part in scorer._contexts(("k",), (frame[i : i + 10_000] for i in range(0, n, 10_000)), state):
        most = max(most, len(part))
        got.append(part[part["line_no"] % 1001 < 3])
    peak = tracemalloc.get_traced_memory()[1] - base
    tracemalloc.stop()
    assert most <= 50_000 and peak < 100 * n
    got = pd.concat(got, ignore_index=True)
    known = [8, 9, *[i % 5 for i in range(n) if i % 7]]
    before = got["line_no"].to_numpy() - (got["line_no"].to_numpy() + 6) // 7
    assert (got["seen"] == before + 5).all() and got["line_no"].is_monotonic_increasing
    assert (got["c1"] == [known[b + 1] for b in before]).all() and (got["c2"] == [known[b] for b in before]).all()
    assert got["template_index"].isna().equals((got["line_no"] % 7 == 0).astype(bool)) and got["timestamp"].isna().sum() == 3
    assert state.value == ([known[-2], known[-1]], 5 + len(known) - 2)
