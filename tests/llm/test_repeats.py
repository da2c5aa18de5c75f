from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import automaton, repeats, suffixarray
from tidelog.llm.repeats import LENGTH

from .helpers import AWKWARD, documents, words


def brute_force(rows: list[tuple]) -> list[tuple[int, int, int, int]]:
    """Spans by comparing every window with those of all earlier documents."""
    first: dict[tuple, int] = {}
    out = []
    for doc, text in sorted((r for r in set(rows) if r[0] is not None and r[1] is not None)):
        w = text.split()
        grams = [tuple(w[i : i + LENGTH]) for i in range(len(w) - LENGTH + 1)]
        covered = np.zeros(len(w) + 1, dtype=bool)
        for i, g in enumerate(grams):
            if first.get(g, doc) < doc:
                covered[i : i + LENGTH] = True
        for g in grams:
            first.setdefault(g, doc)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        out += [(doc, int(a), int(b) - 1, int(b - a)) for a, b in zip(edges[::2], edges[1::2])]
    return sorted(out)


def corpus(seed: int, n: int = 60) -> list[tuple[int, str]]:
    """Random documents that share passages of 40 to 400 words, some of them overlapping, some cyclic."""
    rng = random.Random(seed)
    passages = [words(1000 * seed + i, rng.randrange(40, 400)).split() for i in range(12)]
    passages.append(("tick tock " * 100).split())
    rows = []
    for d in range(n):
        parts: list[str] = words(50_000 * seed + d, rng.randrange(0, 200)).split()
        for _ in range(rng.randrange(4)):
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 2)
            parts += p[a : rng.randrange(a, len(p)) + 1]
            parts += words(90_000 * seed + d, rng.randrange(30)).split()
        rows.append((d, " ".join(parts) if d % 3 else "\n ".join(parts)))
    rows += [(n + i, rows[i][1]) for i in range(5)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("operator", ["broadcast", "shuffled", "suffixarray"])
def test_matches_brute_force(spark, monkeypatch, seed, operator):
    rows = corpus(seed)
    docs = documents(spark, rows)
    if operator == "shuffled":
        monkeypatch.setattr(automaton, "BROADCAST_WORDS", -1)
    module = suffixarray if operator == "suffixarray" else automaton
    got = sorted(tuple(r) for r in module.repeated_spans(docs).collect())
    assert got == brute_force(rows) and got


@pytest.mark.parametrize("most", [0, 700])
def test_families_compared_by_windows_give_the_same(spark, monkeypatch, most):
    rows = corpus(7)
    docs = documents(spark, rows)
    for module, name, value in ((automaton, "BROADCAST_WORDS", -1), (automaton, "TASK_WORDS", most), (suffixarray, "TASK_WORDS", most)):
        monkeypatch.setattr(module, name, value)
    want = brute_force(rows)
    assert sorted(tuple(r) for r in automaton.repeated_spans(docs).collect()) == want
    assert sorted(tuple(r) for r in suffixarray.repeated_spans(docs).collect()) == want


def test_one_passage_in_very_many_documents(spark, monkeypatch):
    """20,000 documents hold one passage, each in surroundings of its own: no task gathers them."""
    passage = words(1, 60)
    df = spark.range(20_000).selectExpr("id as doc_id", f"concat_ws(' ', transform(sequence(1, 60), i -> concat('a', id * 1000 + i)), '{passage}', transform(sequence(61, 90), i -> concat('b', id * 1000 + i))) as text")
    for module in (automaton, suffixarray):
        got = module.repeated_spans(df).groupBy("start_word", "end_word", "n_words").agg(F.count("*").alias("n"), F.min("doc_id").alias("least")).collect()
        assert [tuple(r) for r in got] == [(60, 119, 60, 19_999, 1)]


def test_small_shards_and_buckets_give_the_same(spark, monkeypatch):
    rows = corpus(3)
    docs = documents(spark, rows)
    for module, name, value in ((automaton, "SHARD_WORDS", 300), (automaton, "BROADCAST_WORDS", -1), (suffixarray, "BUCKET_WORDS", 64), (suffixarray, "BLOCK_WORDS", 1000)):
        monkeypatch.setattr(module, name, value)
    want = brute_force(rows)
    assert sorted(tuple(r) for r in automaton.repeated_spans(docs).collect()) == want
    assert sorted(tuple(r) for r in suffixarray.repeated_spans(docs).collect()) == want


def test_automaton_finds_every_shared_run():
    rng = random.Random(5)
    for _ in range(30):
        sam = automaton.SuffixAutomaton()
        texts = [[rng.randrange(3) for _ in range(rng.randrange(60, 200))] for _ in range(3)]
        for d, t in enumerate(texts[:2]):
            sam.add(t, d)
        seen = {tuple(t[i : i + LENGTH]) for t in texts[:2] for i in range(len(t) - LENGTH + 1)}
        probe = texts[2] + texts[0][5:70] + texts[1][3:60]
        covered = set()
        for i in range(len(probe) - LENGTH + 1):
            if tuple(probe[i : i + LENGTH]) in seen:
                covered |= set(range(i, i + LENGTH))
        assert {i for a, b in automaton.spans_of(sam.windows(probe, 2)) for i in range(a, b)} == covered


@pytest.mark.parametrize("broadcast", [True, False])
def test_window_across_two_matches_is_new(spark, monkeypatch, broadcast):
    """Document 2 joins text of 0 and of 1 with an overlap; the windows across the join are its own, and 3 repeats them."""
    if not broadcast:
        monkeypatch.setattr(automaton, "BROADCAST_WORDS", -1)
    w = words(60, 140).split()
    rows = [(0, " ".join(w[:75])), (1, " ".join(w[65:])), (2, " ".join(w)), (3, "x " + " ".join(w[40:110]))]
    want = brute_force(rows)
    assert (2, 0, 139, 140) in want and (3, 1, 70, 70) in want
    docs = documents(spark, rows)
    assert sorted(tuple(r) for r in automaton.repeated_spans(docs).collect()) == want
    assert sorted(tuple(r) for r in suffixarray.repeated_spans(docs).collect()) == want


def test_suffix_array_is_sorted(monkeypatch):
    monkeypatch.setattr(suffixarray, "BUCKET_WORDS", 40)
    rng = np.random.default_rng(0)
    for trial in range(60):
        w = rng.integers(0, rng.integers(1, 5) + 1, int(rng.integers(1, 200)))
        w = np.concatenate([w, w, w]) if trial % 3 == 0 else w
        text = w.tolist()
        assert suffixarray.suffix_array(w).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_anchors_are_the_same_wherever_a_window_stands():
    rng = np.random.default_rng(1)
    shared = rng.integers(1, 2**63, 60).astype(np.uint64)
    for low in (0, 17, 3990, 4090, 9000):
        text = np.concatenate([rng.integers(1, 2**63, low).astype(np.uint64), shared, rng.integers(1, 2**63, 30).astype(np.uint64)])
        anchor, first, last = repeats.anchors(text)
        assert first[0] == 0 and last[-1] == len(text) - LENGTH and (first[1:] == last[:-1] + 1).all()
        own = {int(w - low): int(a) for a, f, t in zip(anchor, first, last) for w in range(f, t + 1) if low <= w <= low + 10}
        assert own == {int(w): int(a) for a, f, t in zip(*repeats.anchors(shared)) for w in range(f, t + 1)}


@pytest.mark.parametrize("module", [automaton, suffixarray])
def test_awkward_rows(spark, module):
    passage = words(77, 60)
    rows = [*AWKWARD, (200, passage), (201, "before " + passage + " after"), (202, passage), (202, passage), (203, words(5, 30_000)), (204, passage), (204, "other text " + passage)]
    docs = documents(spark, rows, clash=True)
    got = sorted(tuple(r) for r in module.repeated_spans(docs).collect())
    assert got == [(201, 1, 60, 60), (202, 0, 59, 60), (203, 0, 29_999, 30_000), (204, 0, 59, 60), (204, 2, 61, 60)]
    clean = module.remove_repeats(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = {(r.doc_id, r.n_chars): r.text for r in clean.collect() if r.doc_id and r.doc_id >= 200}
    assert sorted(text.values()) == sorted(["", "", "", passage, "before after", "other text "])


@pytest.mark.parametrize("module", [automaton, suffixarray])
def test_null_texts_stay_and_empty_tables(spark, module):
    docs = documents(spark, AWKWARD)
    assert sorted(map(str, module.remove_repeats(docs).collect())) == sorted(map(str, docs.collect()))
    empty = docs.where(F.lit(False))
    assert module.repeated_spans(empty).collect() == [] and module.remove_repeats(empty).collect() == []


def test_removal_leaves_no_repeat(spark):
    docs = documents(spark, corpus(4))
    clean = automaton.remove_repeats(docs)
    rows = [(r.doc_id, r.text) for r in clean.collect()]
    removed = {r.doc_id for r in automaton.repeated_spans(docs).collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    assert all(t == kept[d] for d, t in rows if d not in removed)
    again = brute_force(rows)
    assert sum(r[3] for r in again) < 0.02 * sum(r[3] for r in brute_force(corpus(4)))  # only where removal joined two ends


def test_shuffled_cuts_give_the_same(spark, monkeypatch):
    docs = documents(spark, corpus(6, 20))
    want = sorted(automaton.remove_repeats(docs).collect())
    monkeypatch.setattr(repeats, "BROADCAST_CUTS", -1)
    assert sorted(automaton.remove_repeats(docs).collect()) == want
