from __future__ import annotations

import numpy as np
import pyarrow as pa
import random
from pyspark.sql import functions as F

from tidelog.llm import minhash

from .helpers import AWKWARD, documents, words


def edited(text: str, seed: int, share: float = 0.05) -> str:
    rng = random.Random(seed)
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def shingle_set(text: str) -> set:
    w = [x.strip(".,;:!?'\"()").lower() for x in text.split()]
    return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))}


def test_signature_agreement_estimates_jaccard():
    base = words(1, 600)
    texts = [base, edited(base, 2, 0.02), edited(base, 3, 0.1), edited(base, 4, 0.4), words(7, 600)]
    sig, has = minhash.signatures(pa.array(texts))
    assert has.all() and (sig != minhash.EMPTY).all()
    for i in range(1, 5):
        a, b = shingle_set(texts[0]), shingle_set(texts[i])
        assert abs((sig[0] == sig[i]).mean() - len(a & b) / len(a | b)) < 0.15


def test_densified_bins_agree_for_short_texts():
    sig, has = minhash.signatures(pa.array(["two words", "Two  words.", "other words", "", None, "one"]))
    assert has.tolist() == [True, True, True, False, False, True]
    assert (sig[0] == sig[1]).all() and (sig[0] != sig[2]).any()


def brute_force(rows: list[tuple[int, str]], threshold: float = 0.7) -> list[set[int]]:
    sets = {i: shingle_set(t) for i, t in rows}
    group = {i: i for i, _ in rows}

    def root(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    out: dict[int, set[int]] = {}
    for i in sets:
        out.setdefault(root(i), set()).add(i)
    return [g for g in out.values() if len(g) > 1]


def test_groups_match_brute_force(spark):
    rows = []
    for g in range(30):
        base = words(100 + g, 50 + 20 * g)
        rows += [(10 * g + k, base if k == 0 else edited(base, 10 * g + k, 0.03)) for k in range(1 + g % 5)]
    got = minhash.near_duplicates(documents(spark, rows)).collect()
    groups: dict[int, set[int]] = {}
    for r in got:
        groups.setdefault(r.keep_id, {r.keep_id}).add(r.doc_id)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, brute_force(rows)))
    assert all(min(g) == k for k, g in groups.items())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([((i, 5), (i + 1, 5)) for i in range(40)] + [((100, 1), (100, 2))], f"a {minhash.NODE}, b {minhash.NODE}")
    labels = {(r.id.d, r.id.h): (r.label.d, r.label.h) for r in minhash.components(edges).collect()}
    assert labels == {(i, 5): (0, 5) for i in range(41)} | {(100, 1): (100, 1), (100, 2): (100, 1)}


def test_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (107, words(5, 30_000)), (108, "SAME, same same!")], clash=True)
    got = {r.doc_id: r.keep_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {107: 105, 108: 106}
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 2
    assert kept.where("doc_id is null").count() == 1 and kept.where("doc_id = 106").count() == 2


def test_shuffled_join_gives_the_same(spark, monkeypatch):
    docs = documents(spark, [*AWKWARD, (107, words(5, 30_000))])
    want = sorted(map(str, minhash.drop_near_duplicates(docs).select("doc_id").collect()))
    monkeypatch.setattr(minhash, "BROADCAST_IDS", -1)
    assert sorted(map(str, minhash.drop_near_duplicates(docs).select("doc_id").collect())) == want


def test_empty_table(spark):
    empty = documents(spark, [(1, "a")]).where(F.lit(False))
    assert minhash.near_duplicates(empty).collect() == []
    assert minhash.drop_near_duplicates(empty).collect() == []


def test_big_group_has_star_edges_only(spark):
    docs = documents(spark, [(i, "the same text in every document of this group") for i in range(500)])
    signed = docs.select(F.expr("struct(doc_id as d, xxhash64(text) as h)").alias("id"), "text").mapInArrow(minhash._sign, f"id {minhash.NODE}, bands array<long>, sig binary")
    assert minhash.candidate_edges(signed).count() == 499
    assert minhash.near_duplicates(docs).count() == 499


def test_densification_is_deterministic():
    a, _ = minhash.signatures(pa.array(["alpha beta gamma"]))
    b, _ = minhash.signatures(pa.array(["x y", "alpha beta gamma"]))
    assert np.array_equal(a[0], b[1])


def test_one_id_with_two_texts(spark):
    """Document 5 has two texts: one is repeated by 9, the other repeats 3; no text is left nowhere."""
    a, b = words(1, 60), words(2, 60)
    docs = documents(spark, [(3, b), (5, a), (5, b), (9, a), (7, words(3, 60)), (7, words(3, 60))])
    assert sorted(tuple(r) for r in minhash.near_duplicates(docs).collect()) == [(5, 3), (9, 5)]
    kept = sorted((r.doc_id, r.text) for r in minhash.drop_near_duplicates(docs).collect())
    assert kept == sorted([(3, b), (5, a), (7, words(3, 60)), (7, words(3, 60))])


def test_recall_of_pairs_from_the_stated_similarity(spark):
    """Pairs of a Jaccard similarity of 0.6 to 0.7 against brute force."""
    rows, alike = [], []
    for g in range(150):
        base = words(7000 + g, 200, 10**6)
        other = edited(base, g, 0.11)
        a, b = shingle_set(base), shingle_set(other)
        rows += [(2 * g, base), (2 * g + 1, other)]
        if 0.6 <= len(a & b) / len(a | b) < 0.7:
            alike.append(2 * g + 1)
    found = {r.doc_id: r.keep_id for r in minhash.near_duplicates(documents(spark, rows)).collect()}
    assert len(alike) > 60 and sum(found.get(i) == i - 1 for i in alike) >= 0.95 * len(alike)
    assert all(i == k + 1 for i, k in found.items())
