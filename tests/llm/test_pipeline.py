"""The pipeline against a restatement in Python of what each stage must do, on documents with planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import mixing, packing, scratch, tokens
from tidelog.llm.repeats import LENGTH

from .helpers import AWKWARD, SCHEMA, documents

STEMS = {"en": ["the", "and", "tion", "ing", "er"], "de": ["der", "ung", "sch", "keit", "lich"]}


def prose(seed: int, n: int, lang: str = "en") -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(STEMS[lang]) for _ in range(rng.randrange(1, 5))) + f"{chr(97 + rng.randrange(26))}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows, copies, near = [], {}, {}
    passage = prose(9_999, 70)
    for i in range(120):
        lang = "en" if i % 3 else "de"
        rows.append((i, prose(i, 60 + i % 90, lang), lang, f"src{i % 4 if i % 7 else 0}"))
    for i in range(8):
        rows.append((200 + i, rows[i][1], rows[i][2], "src1"))
        copies[200 + i] = i
        words = rows[20 + i][1].split()
        words[5 + i] = "changed"
        rows.append((300 + i, " ".join(words), rows[20 + i][2], "src2"))
        near[300 + i] = 20 + i
    shared = [400 + i for i in range(6)]
    rows += [(d, prose(5000 + d, 40) + " " + passage + " " + prose(6000 + d, 40), "en", "src3") for d in shared]
    rows += [(500, "", "en", "src1"), (501, None, "en", "src1"), (None, prose(77, 90), "en", None), (502, "word", "en", "src1")]
    folder = tmp_path_factory.mktemp("sf")
    df = spark.createDataFrame([(*r[:4], len(r[1]) if r[1] is not None else None) for r in rows], SCHEMA)
    df.write.parquet(str(folder / "documents.parquet"))
    return str(folder), rows, copies, near, shared, passage


@pytest.fixture(scope="module")
def stages(spark, corpus, tmp_path_factory):
    folder = corpus[0]
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "substring_dedup", "source_mixing", "power_of_two_packing"]
    assert all(df.columns == ["doc_id", "text", "lang", "source", "n_chars"] for df in stages[:-1])


def test_language_id_drops_empty_texts_only(stages, corpus):
    kept = {r.doc_id for r in stages[0].collect()}
    assert kept == {r[0] for r in corpus[1]} - {500, 501}


def test_near_dedup_keeps_one_of_each_group(stages, corpus):
    _, rows, copies, near, *_ = corpus
    kept = [r.doc_id for r in stages[1].collect()]
    assert sorted(kept, key=str) == sorted({r[0] for r in rows} - {500, 501} - set(copies) - set(near), key=str)


def test_substring_dedup_leaves_one_occurrence(stages, corpus):
    shared, passage = corpus[4:]
    before, after = ({r.doc_id: r for r in df.collect()} for df in stages[1:3])
    assert set(before) == set(after)
    first: set[tuple] = set()
    for d in sorted(i for i in before if i is not None):
        w = before[d].text.split()
        grams = [tuple(w[i : i + LENGTH]) for i in range(len(w) - LENGTH + 1)]
        gone = {i + j for i, g in enumerate(grams) if g in first for j in range(LENGTH)}
        assert after[d].text.split() == [x for i, x in enumerate(w) if i not in gone]
        assert after[d].n_chars == len(after[d].text)
        first |= set(grams)
    assert [passage in after[d].text for d in shared] == [True] + [False] * 5
    assert after[None].text == before[None].text


def test_source_mixing_draws_by_the_weights(spark, stages):
    docs, mixed = stages[2], stages[3]
    want = mixing.draws(docs).groupBy("doc_id", "source").count()
    assert sorted(map(str, mixed.groupBy("doc_id", "source").count().collect())) == sorted(map(str, want.collect()))
    assert mixed.join(docs, docs.columns, "left_anti").where("doc_id is not null and source is not null").count() == 0


def test_packing_restores_the_mixed_texts(stages):
    coder = tokens.encoding(tokens.VOCABULARY)
    texts = {r.doc_id: r.text for r in stages[3].collect()}
    pieces: dict = {}
    for r in stages[4].collect():
        assert len(r.tokens) == r.length == 1 << r.bucket <= packing.LONGEST
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    assert set(pieces) == {i for i, t in texts.items() if t}
    for i, p in pieces.items():
        assert coder.decode([x for k in sorted(p) for x in p[k].tokens]) == texts[i]


def test_run_equals_the_stages(spark, stages, corpus):
    got = corpus_pipeline.run(spark, corpus[0])
    columns = ["bucket", "doc_id", "piece", "start", "length"]
    assert sorted(map(str, got.select(columns).collect())) == sorted(map(str, stages[4].select(columns).collect()))


def test_pipeline_with_awkward_rows_and_clashing_columns(spark, corpus, tmp_path):
    """Nulls, empty and very long texts, a million blanks, repeated rows, and columns named like those that stages use."""
    rows = [*AWKWARD, (110, "a" + " " * 1_100_000 + "b"), (111, prose(1, 80)), (111, prose(1, 80)), (112, prose(1, 80))] + [(600 + i, prose(i, 70)) for i in range(40)]
    docs = documents(spark, rows, clash=True)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.written(stage(spark, docs, str(tmp_path)), name)
        assert out.columns == docs.columns
        assert {tuple(r) for r in out.select("label", "block", "epoch", "key").distinct().collect()} == {("x", "b", "e", "k")}
        docs = out
    kept = {r.doc_id for r in docs.collect()}
    assert not kept & {100, 101, 102, 112}
    got = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.where("length(text) > 0").collect()}
    scratch.clear(spark)


def test_pipeline_over_nothing(spark, corpus, tmp_path):
    empty = spark.read.parquet(f"{corpus[0]}/documents.parquet").where(F.lit(False))
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    scratch.clear(spark)
