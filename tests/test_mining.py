"""The indexed miner against one that compares every cluster of a leaf."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tidelog.operators import drain


class SlowMiner(drain.Miner):
    def add(self, message):
        tokens = message.split()
        leaf = self._leaf(tokens, create=False)
        best, score = None, (-1.0, -1)
        for cluster in leaf.clusters if leaf else ():
            same = sum(a == b for a, b in zip(cluster.tokens, tokens, strict=True) if a != drain.WILD)
            rank = (same / len(tokens) if tokens else 1.0, sum(a == drain.WILD for a in cluster.tokens))
            if rank > score:
                best, score = cluster, rank
        if best is None or score[0] < self.params.similarity:
            best = drain.Cluster(len(self.clusters) + 1, tokens)
            self.clusters.append(best)
            self._leaf(tokens, create=True).clusters.append(best)
        else:
            best.tokens = [a if a == b else drain.WILD for a, b in zip(best.tokens, tokens, strict=True)]
        return best


@pytest.mark.parametrize("params", [drain.DrainParams(), drain.DrainParams(3, 0.7, 5), drain.DrainParams(2, 0.0), drain.DrainParams(5, 1.0, 3), drain.DrainParams(4, 1.1)])
def test_index_finds_what_all_comparisons_find(params):
    rng = np.random.default_rng(2)
    words = np.array(["<*>", "n7", *[f"w{chr(97 + i)}" for i in range(18)]])
    fast, slow = drain.Miner(params), SlowMiner(params)
    for _ in range(1500):
        text = " ".join(words[np.minimum(rng.geometric(0.12, int(rng.choice([0, 3, 5, 6]))) - 1, 19)])
        a, b = fast.add(text), slow.add(text)
        assert (a.number, a.tokens, a.text) == (b.number, b.tokens, " ".join(b.tokens))


def test_dissimilar_messages_stay_fast():
    """Of 6000 messages nearly each is a cluster of its own; comparing all took 85 s."""
    rng = np.random.default_rng(3)
    texts = [" ".join(["same", "start", *(f"w{chr(97 + i % 26)}{i}" for i in rng.integers(0, 2000, 14))]) for _ in range(6000)]
    miner, began = drain.Miner(), time.process_time()
    for text in texts:
        miner.add(text)
    assert len(miner.clusters) > 5900 and time.process_time() - began < 5


@pytest.mark.parametrize("size", [16, 4096])
def test_repeated_messages_are_one_row(spark, monkeypatch, size):
    """Snapshots of templates, late merges, literal wild tokens and sources, against a miner that reads line by line; no task gets a row per line."""
    monkeypatch.setattr(drain, "CHUNK", size)
    rng = np.random.default_rng(7)
    words = np.array(["<*>", "n7", *[f"w{chr(97 + i)}" for i in range(6)]])
    pool = [" ".join(words[np.minimum(rng.geometric(0.3, int(n)) - 1, 7)]) for n in rng.choice([0, 1, 3, 4, 5], 60)]
    lines = [(i, ["x", "", None][i % 3], pool[int(min(rng.geometric(0.06) - 1, 59))] if i % 50 else None) for i in range(1500)]
    df = spark.createDataFrame(lines, "line_no long, host string, masked string").repartition(5)
    got = {r.line_no: (r.template_id, r.template) for r in drain.mine(df, source="host").collect()}
    miners = {h: drain.Miner() for h in ("x", "", None)}
    for i, host, text in lines:
        cluster = miners[host].add(text) if text is not None else None
        assert got[i] == (cluster and str(cluster.number), cluster and cluster.text)
    calls = [("a b c", np.arange(1000)), ("a b d", np.array([500, 700]))]
    rows = list(drain.mined_chunk(drain.Miner(), calls))
    assert rows == [("a b c", [0, 501], [1, 1], ["a b c", "a b <*>"]), ("a b d", [500], [1], ["a b <*>"])]
