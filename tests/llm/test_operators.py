"""Media, tokens, mixing, language ID, quality, neighbours and packing."""

from __future__ import annotations

import io
import math
import wave

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidelog.llm import ann, langid, media, mixing, packing, quality, sampling, scratch, tokens

from .helpers import AWKWARD, documents, words

# --- media


def wav(data: bytes, width: int = 1, channels: int = 1, rate: int = 8000) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(width)
        w.setframerate(rate)
        w.writeframes(data)
    return out.getvalue()


def slow_peaks(x: np.ndarray) -> list[tuple[int, int]]:
    n = media.n_frames(len(x))
    x = np.pad(x.astype(np.float64), (0, max(0, (n - 1) * media.HOP + media.FRAME - len(x))))
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(media.FRAME) / media.FRAME)
    s = np.array([np.log(np.abs(np.fft.rfft(x[t * media.HOP : t * media.HOP + media.FRAME] * window)) ** 2 + 1e-6) for t in range(n)])
    out = []
    for t in range(n):
        for f in range(s.shape[1]):
            near = s[max(0, t - media.REACH_TIME) : t + media.REACH_TIME + 1, max(0, f - media.REACH_BIN) : f + media.REACH_BIN + 1]
            if s[t, f] >= near.max() and s[t, f] > s[t].mean() + media.FLOOR:
                out.append((t, f))
    return out


def test_wav_expression_is_read_by_the_wave_module(spark):
    texts = ["abc", "été", "", "x" * 1001, None]
    df = documents(spark, list(enumerate(texts))).select("doc_id", media.wav_of("text").alias("wav"))
    for r in df.collect():
        t = texts[r.doc_id]
        assert (r.wav is None) == (t is None)
        if t is not None:
            with wave.open(io.BytesIO(bytes(r.wav))) as w:
                assert (w.getnchannels(), w.getsampwidth(), w.getframerate(), w.readframes(w.getnframes())) == (1, 1, media.RATE, t.encode())
            assert len(r.wav) % 2 == 0 and bytes(r.wav)[:44][8:40] == wav(t.encode())[8:40]


def test_peaks_match_slow_version(monkeypatch):
    rng = np.random.default_rng(0)
    t = np.arange(60_000) / 8000
    x = np.sin(2 * np.pi * 700 * t) * (t % 1 < 0.5) + 0.5 * np.sin(2 * np.pi * (300 + 200 * t) * t) + rng.normal(0, 0.1, len(t))
    want = slow_peaks(x.astype(np.float32))
    got = list(zip(*(a.tolist() for a in media.peaks(x.astype(np.float32)))))
    assert len(set(got) ^ set(want)) <= 0.02 * len(want) and len(want) > 50  # float32 against float64
    monkeypatch.setattr(media, "CHUNK_FRAMES", 17)
    assert list(zip(*(a.tolist() for a in media.peaks(x.astype(np.float32))))) == got


def test_pairs_by_hand():
    codes, times = media.pairs(np.array([0, 0, 5, 40]), np.array([10, 200, 30, 7]))
    assert times.tolist() == [0, 0, 0] and codes.tolist() == [10 << 20 | 200 << 8 | 0, 10 << 20 | 30 << 8 | 5, 200 << 20 | 30 << 8 | 5]


def test_shifted_recording_shares_fingerprints():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 30, 40_000).cumsum() % 256).astype(np.uint8)
    shift = 7 * media.HOP
    a, b = media.fingerprint(wav(x.tobytes())), media.fingerprint(wav(x[shift:].tobytes()))
    at = {(c, t - 7) for c, t in zip(a[4].tolist(), a[5].tolist())}
    both = {(c, t) for c, t in zip(b[4].tolist(), b[5].tolist())}
    assert len(at & both) > 0.9 * len(both)


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_sample_widths_and_channels(width):
    if width == 1:
        raw = np.array([0, 128, 255, 128], np.uint8).tobytes()
    else:
        raw = b"".join(int(v * (1 << (8 * width - 1))).to_bytes(width, "little", signed=True) for v in (-1, 0, 0.5, 0))
    rate, x = media.samples(wav(raw, width, 2, 44100))
    assert rate == 44100 and np.allclose(x, [-0.5, 0.496] if width == 1 else [-0.5, 0.25], atol=0.01)


def test_broken_headers_are_errors(spark):
    import random

    rng, base = random.Random(0), wav(bytes(range(256)) * 8)
    rows = [(1, wav(b"\0" * 60, 4)), (2, base)]
    for width in (5, 6, 8, 9, 200):
        b = bytearray(base)
        b[32:36] = (width).to_bytes(2, "little") + (8 * width).to_bytes(2, "little")
        rows.append((width, bytes(b)))
    big = bytearray(base)
    big[24:28] = b"\xff" * 4
    rows.append((300, bytes(big)))
    for i in range(300):
        b = bytearray(base if i % 4 else base[: rng.randrange(len(base))])
        for _ in range(rng.randrange(1, 6)):
            if b:
                b[rng.randrange(min(len(b), 60))] = rng.choice([0, 1, 2, 4, 255, rng.randrange(256)])
        rows.append((1000 + i, bytes(b)))
    got = {r.doc_id: r for r in media.fingerprints(spark.createDataFrame([(i, bytearray(b)) for i, b in rows], "doc_id long, wav binary")).collect()}
    assert got[1].error is None and got[2].error is None and len(got) == len(rows)
    assert all(got[i].error and got[i].codes is None for i in (5, 6, 8, 9, 200, 300))


def test_equal_cells_have_one_peak(monkeypatch):
    """Silence and a spectrum with ties: the earliest and lowest of equal neighbours is the only peak."""
    assert media.peaks(np.zeros(5000, np.float32))[0].tolist() == []
    monkeypatch.setattr(media, "spectrum", lambda x, a, b: np.where((np.arange(a, b)[:, None] % 20 < 3) & (np.arange(257) % 50 < 4), np.float32(9), np.float32(0)))
    t, f = media.peaks(np.zeros(media.HOP * 100, np.float32))
    assert set(t.tolist()) == {0, 20, 40, 60, 80} and set(f.tolist()) == set(range(0, 257, 50))


def test_awkward_media(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFnonsense"), (4, wav(b"")), (5, wav(b"\x80" * 10)), (6, wav(bytes(range(256)) * 40)), (6, wav(bytes(range(256)) * 40)), (None, wav(b"\x80" * 3000))]
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "x") for i, b in rows], "doc_id long, wav binary, codes string")
    got = media.fingerprints(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].n_samples is None and by[1].error is None
    assert by[2].error and by[3].error and by[2].codes is None
    assert by[4].n_samples == 0 and by[4].codes == [] and by[5].n_samples == 10
    assert len([r for r in got if r.doc_id == 6 and r.n_peaks == by[6].n_peaks and r.codes == by[6].codes]) == 2 and by[6].n_samples == 10_240
    assert all(len(r.codes) == len(r.times) and r.times == sorted(r.times) for r in got if r.codes is not None)
    assert media.fingerprints(df.where(F.lit(False))).collect() == []


# --- tokens


def test_blocks_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for trial in range(40):
        counts = rng.integers(0, 500, int(rng.integers(1, 8)))
        ids = rng.choice(np.array([0, 5, 1000, 50_000, 2**32 - 1], np.uint32), counts.sum(), p=[0.02, 0.5, 0.3, 0.15, 0.03]) if trial % 2 else rng.integers(0, 50_257, counts.sum()).astype(np.uint32)
        data, length, starts, blocks = tokens.pack(ids, counts)
        at = first = token = 0
        for n, size, b in zip(counts, length, blocks):
            payload, index = data[at : at + size].tobytes(), starts[first : first + b].tolist()
            assert tokens.unpack(payload, index, int(n)).tolist() == ids[token : token + n].tolist()
            if b > 1:
                assert tokens.unpack_block(payload, index[1], min(tokens.BLOCK, int(n) - tokens.BLOCK)).tolist() == ids[token + tokens.BLOCK : token + min(n, 2 * tokens.BLOCK)].tolist()
            at, first, token = at + size, first + b, token + n


def test_outliers_do_not_widen_the_block():
    ids = np.full(128, 7, np.uint32)
    ids[3] = 2**31
    data, *_ = tokens.pack(ids, np.array([128]))
    assert data[4] == 0 and data[5] == 1 and len(data) == tokens.HEADER + 5


def test_bit_length_is_exact():
    x = np.array([0, 1, 2, 3, 4, 2**31 - 1, 2**31, 2**32 - 1], np.uint32)
    assert tokens.bit_length(x).tolist() == [int(v).bit_length() for v in x.tolist()]


def test_tokens_of_awkward_rows(spark):
    docs = documents(spark, [*AWKWARD, (200, "<|endoftext|> plain")], clash=True)
    got = tokens.packed_tokens(docs).collect()
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    coder: tiktoken.Encoding = tokens.encoding(tokens.VOCABULARY)
    assert len(got) == len(texts)
    for r in got:
        if r.payload is None:
            assert r.doc_id == 100 and r.n_tokens is None and r.block_starts is None
        else:
            ids = tokens.unpack(bytes(r.payload), r.block_starts, r.n_tokens).tolist()
            assert (r.doc_id, coder.decode(ids)) in texts
    assert tokens.packed_tokens(docs.where(F.lit(False))).collect() == []


@pytest.mark.parametrize("blanks", [" ", "\n", " \n\t\u00a0\u3000"])
@pytest.mark.parametrize("size", [1_000_000, 2_000_000, 10_000_000])
def test_long_white_space(blanks, size):
    """Beyond what the regular expression stands; under it (first assertions) cut and uncut encoding agree."""
    coder = tokens.encoding(tokens.VOCABULARY)
    short = (blanks * tokens.RUN)[: tokens.RUN + 7]
    for text in (short, "a" + short + "b", short + "'s", "x\x1c" + short + "1" + short, short[:-20] + "!"):
        assert tokens.ids_of(coder, text) == coder.encode_ordinary(text)
    text = "a" + (blanks * size)[:size] + "b"
    assert coder.decode(tokens.ids_of(coder, text)) == text


def test_long_white_space_in_tables(spark):
    rows = [(1, "a" + " " * 1_200_000 + "b"), (2, "\n" * 1_500_000), (3, "x")]
    docs = documents(spark, rows)
    coder = tokens.encoding(tokens.VOCABULARY)
    got = {r.doc_id: r for r in tokens.packed_tokens(docs).collect()}
    pieces = packing.packed(docs).orderBy("doc_id", "piece").collect()
    for i, text in rows:
        ids = tokens.unpack(bytes(got[i].payload), got[i].block_starts, got[i].n_tokens).tolist()
        assert coder.decode(ids) == text and [t for p in pieces if p.doc_id == i for t in p.tokens] == ids


def slow_blocks(ids: list[int]) -> tuple[bytes, list[int]]:
    """The format restated with Python's integers."""
    out, starts = b"", []
    for low in range(0, len(ids), tokens.BLOCK):
        block = ids[low : low + tokens.BLOCK]
        least = min(block)
        lengths = sorted((x - least).bit_length() for x in block)
        width = lengths[math.ceil(tokens.PERCENTILE * len(block)) - 1]
        odd = [(i, (x - least) >> width) for i, x in enumerate(block) if (x - least) >> width]
        packed = sum(((x - least) & ((1 << width) - 1)) << (width * i) for i, x in enumerate(block))
        starts.append(len(out))
        out += least.to_bytes(4, "little") + bytes([width, len(odd)]) + packed.to_bytes(-(-len(block) // 8) * width, "little")
        out += bytes(i for i, _ in odd) + b"".join(h.to_bytes(4, "little") for _, h in odd)
    return out, starts


def test_query_matches_slow_blocks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    coder = tokens.encoding(tokens.VOCABULARY)
    text = {r.doc_id: r.text for r in docs.collect()}
    got = tokens.packed_tokens(docs).collect()
    assert len(got) == len(text)
    for r in got:
        ids = coder.encode_ordinary(text[r.doc_id])
        assert (bytes(r.payload), r.block_starts, r.n_tokens) == (*slow_blocks(ids), len(ids))


# --- packing


def slow_pieces(n: int, longest: int) -> list[int]:
    out = []
    while n >= longest:
        out.append(longest)
        n -= longest
    while n:
        out.append(1 << (n.bit_length() - 1))
        n -= out[-1]
    return out


def test_pieces_match_slow_version():
    counts = np.array([0, 1, 2, 3, 7, 8, 100, 8191, 8192, 8193, 30_000])
    row, length = packing.pieces(counts)
    assert [length[row == i].tolist() for i in range(len(counts))] == [slow_pieces(int(n), packing.LONGEST) for n in counts]


def test_packing_restores_every_document(spark, tmp_path):
    docs = documents(spark, AWKWARD, clash=True)
    out = packing.packed(docs)
    coder = tokens.encoding(tokens.VOCABULARY)
    got = out.collect()
    assert all(len(r.tokens) == r.length == 1 << r.bucket for r in got)
    one = {i: t for i, t in [(r.doc_id, r.text) for r in docs.collect()] if i != 106}
    for i, t in one.items():
        parts = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in parts] == np.cumsum([0, *[r.length for r in parts]])[:-1].tolist()
        assert coder.decode([x for r in parts for x in r.tokens]) == (t or "")
        assert [r.length for r in parts] == slow_pieces(sum(r.length for r in parts), packing.LONGEST)
    assert len([r for r in got if r.doc_id == 106]) == 2 * len({r.piece for r in got if r.doc_id == 106})
    packing.write_buckets(out, str(tmp_path / "buckets"))
    assert spark.read.parquet(str(tmp_path / "buckets")).count() == len(got)
    assert packing.packed(docs.where(F.lit(False))).collect() == []
    with pytest.raises(ValueError):
        packing.packed(docs, longest=100)


# --- mixing


def skewed(spark):
    rows = [(i, words(i, 20 + i % 50), "en", "big" if i % 10 < 7 else f"s{i % 10}") for i in range(400)]
    return documents(spark, [*rows, (900, words(900, 70), "en", None), (901, None, "en", "s8"), (902, "  ", "en", "s8"), (None, words(5, 30), "en", "s9")], clash=True)


@pytest.mark.parametrize("block", [1 << 16, 300])
def test_mixing_matches_sql(spark, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    docs = skewed(spark)
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas().astype({"doc_id": "Int64"}))
    sql = mixing.ORACLE.replace(str(1 << 16), str(block))
    rel = con.sql(sql)
    want = sorted(map(str, rel.fetchall()))
    assert sorted(str(tuple(r)) for r in mixing.draws(docs).select(*rel.columns).collect()) == want
    again = mixing.mixed(docs)
    mine = [F.col(f"mixing_{c}").alias(c) for c in ("epoch", "block", "block_order")]  # the table has columns of these names
    assert {tuple(r) for r in again.select("epoch", "block", "block_order").collect()} == {("e", "b", "o")}
    assert sorted(map(str, again.select("doc_id", "source", *mine).collect())) == sorted(map(str, mixing.draws(docs).select("doc_id", "source", "epoch", "block", "block_order").collect()))
    assert set(docs.columns) <= set(again.columns) and again.where("doc_id in (901, 902)").count() == 0


def test_exponent_meets_the_targets():
    tokens_of = [7000, 1000, 500, 400, 300]
    p = [t / sum(tokens_of) for t in tokens_of]
    a = mixing.exponent(tokens_of, sum(tokens_of), limit=1000)
    w = mixing.weights(p, a)
    assert 0 < a < 1 and math.isclose(-sum(x * math.log(x) for x in w), mixing.ENTROPY * math.log(5), rel_tol=1e-9)
    b = mixing.exponent(tokens_of, sum(tokens_of), limit=1.5)
    assert b > a and math.isclose(max(x * sum(tokens_of) / t for x, t in zip(mixing.weights(p, b), tokens_of)), 1.5, rel_tol=1e-9)
    assert mixing.exponent([5, 5], 10) == 1.0 and mixing.exponent([5], 5) == 1.0


def test_budgets_are_kept(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 200)
    docs = skewed(spark)
    got = mixing.draws(docs).groupBy("source").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("longest")).collect()
    totals = {r["s"]: r["n"] for r in docs.select(F.coalesce("source", F.lit("?")).alias("s"), mixing.n_tokens().alias("n")).groupBy("s").agg(F.sum("n").alias("n")).collect() if r["n"]}
    share = mixing.weights([t / sum(totals.values()) for _, t in sorted(totals.items())], mixing.exponent([t for _, t in sorted(totals.items())], sum(totals.values())))
    own = {k: math.floor(w * sum(totals.values())) for (k, _), w in zip(sorted(totals.items()), share)}
    for r in got:
        assert own[r.source or "?"] - 2 * 70 <= r.n <= own[r.source or "?"]


def test_columns_of_the_input_survive(spark, monkeypatch):
    """Columns named like mixing's own, in any case, keep their values; its numbers get other names."""
    docs = documents(spark, [(i, words(i, 30)) for i in range(20)]).selectExpr("*", "'USER' as block", "'E' as Epoch", "'k' as __key", "1 as __n", "'r' as __row", "'m' as mixing_block")
    got = mixing.mixed(docs)
    assert got.columns == [*docs.columns, "mixing_epoch", "mixing_mixing_block", "block_order"]
    assert {tuple(r) for r in got.select("block", "Epoch", "__key", "__n", "__row", "mixing_block").collect()} == {("USER", "E", "k", 1, "r", "m")}
    assert sorted(r.doc_id for r in got.collect()) == list(range(20))


def test_mixing_long_and_repeated_rows(spark):
    """Repeated rows are drawn each; a document longer than a source's rest is passed over and doesn't keep out shorter ones."""
    rows = [(1, words(1, 30_000), "en", "a")] + [(2, words(2, 40), "en", "a")] * 3 + [(10 + i, words(10 + i, 50), "en", "b") for i in range(20)]
    got = mixing.draws(documents(spark, rows)).collect()
    whole = [r for r in got if r.epoch == 0 and r.doc_id == 2]
    assert len(whole) in (0, 3) and {r.n_tokens for r in got if r.doc_id == 1} <= {30_000}
    own = {r[0]: r for r in mixing.plan({"s:a": 30_120, "s:b": 1000})}
    for key, name in (("s:a", "a"), ("s:b", "b")):
        rest = sum(r.n_tokens for r in got if r.source == name and r.epoch == own[key][2])
        assert own[key][3] - (120 if name == "a" and own[key][3] < 30_000 else 50) <= rest <= own[key][3] or rest == 120
        assert sum(r.n_tokens for r in got if r.source == name and r.epoch < own[key][2]) == own[key][2] * own[key][4]


def test_mixing_nothing(spark):
    docs = documents(spark, [(1, None), (2, "")])
    assert mixing.draws(docs).collect() == [] and mixing.mixed(docs).collect() == []
    assert mixing.draws(docs.where(F.lit(False))).collect() == []


def test_shuffled_blocks_give_the_same(spark, monkeypatch):
    docs = skewed(spark)
    want = sorted(map(str, mixing.draws(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_BLOCKS", 0)
    assert sorted(map(str, mixing.draws(docs).collect())) == want


# --- language ID


def languages(n: int, seed: int = 0) -> tuple[list[str], list[str]]:
    rng = np.random.default_rng(seed)
    stems = {"aa": ["the", "and", "tion", "ing"], "bb": ["der", "ung", "sch", "keit"], "cc": ["que", "ción", "los", "ado"]}
    texts, names = [], []
    for i in range(n):
        name = sorted(stems)[i % 3]
        texts.append(" ".join("".join(rng.choice(stems[name], 2)) for _ in range(int(rng.integers(4, 120)))))
        names.append(name)
    return texts, names


def test_network_learns_held_out_languages():
    model = langid.train(*languages(150))
    texts, names = languages(120, seed=1)
    got = langid.judge(model, pa.array(texts))
    assert np.mean([a == b for a, b in zip(got[0].to_pylist(), names)]) >= 0.97
    labels = got[4].to_pylist()
    assert all(len(lab) == len(t.encode()) for lab, t in zip(labels, texts))


def test_junk_and_untrained_languages_are_rejected_and_clean_texts_stay():
    rng = np.random.default_rng(5)
    other = [" ".join("".join(rng.choice(["zka", "wy", "prz", "ów"], 2)) for _ in range(40)) for _ in range(20)]
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(30)) for _ in range(20)]
    junk = ["12345", "3.14 -2 007 " * 30, "@@## $$ %%% ^^& ***", "   \n\t ", "-", "★☆★☆ ★★☆☆"]
    clean = languages(150, seed=3)
    for names in (["aa"], ["aa", "bb"], ["aa", "bb", "cc"]):
        known = [(t, g) for t, g in zip(*languages(300)) if g in names]
        model = langid.train([t for t, _ in known], [g for _, g in known])
        accepted = lambda texts: np.array(langid.judge(model, pa.array(texts))[2].to_pylist())  # noqa: B023, E731
        mine = [t for t, g in zip(*clean) if g in names]
        assert accepted(mine).mean() >= 0.98
        assert not accepted(junk).any() and not accepted(letters).any() and not accepted(other).any()
        rest = [t for t, g in zip(*clean) if g not in names]
        assert not rest or not accepted(rest).any()


def test_undecided_margin():
    assert langid.undecided(np.array([0.5, 0.1, 0.9, 0.2]), np.array([True, False, True, True])) == 0.2
    assert langid.undecided(np.array([0.5, 0.9]), np.array([True, True])) == 0.0


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    h, c = langid.HIDDEN, 3
    params = [rng.normal(0, 0.5, s).astype(np.float64) for s in ((256, 3 * h), (h, 3 * h), (256, 3 * h), (h, 3 * h), (2 * h, c), (c,))]
    codes, label = rng.integers(97, 103, (5, 4)).astype(np.uint8), np.array([0, 1, 2, 1])

    def loss() -> float:
        active = np.full(5, 4)
        top = [slow_states(codes, params[2 * d], params[2 * d + 1], bool(d)) for d in range(2)]
        del active
        x = top[0] @ params[4][:h] + top[1] @ params[4][h:] + params[5]
        x = x - x.max(axis=-1, keepdims=True)
        p = np.exp(x) / np.exp(x).sum(axis=-1, keepdims=True)
        return float(-np.log(p[:, np.arange(4), label]).mean())

    grads = langid._gradients([p.astype(np.float32) for p in params], codes, label)
    for i, at in ((0, (98, 3)), (0, (99, 20)), (1, (2, 1)), (1, (3, 12)), (1, (4, 20)), (2, (100, 9)), (3, (0, 17)), (4, (3, 1)), (4, (12, 0)), (5, (2,))):
        params[i][at] += 1e-4
        up = loss()
        params[i][at] -= 2e-4
        down = loss()
        params[i][at] += 1e-4
        assert abs((up - down) / 2e-4 - grads[i][at]) < 2e-3 * max(1e-2, abs(grads[i]).max()) + 1e-5


def slow_states(codes, table, weights, reverse):
    h = weights.shape[0]
    out, state = np.zeros((*codes.shape, h)), np.zeros((codes.shape[1], h))
    sig = lambda v: 1 / (1 + np.exp(-v))
    for t in range(len(codes))[:: -1 if reverse else 1]:
        x = table[codes[t]]
        g = sig(x[:, : 2 * h] + state @ weights[:, : 2 * h])
        new = np.tanh(x[:, 2 * h :] + (g[:, h:] * state) @ weights[:, 2 * h :])
        state = state + g[:, :h] * (new - state)
        out[t] = state
    return out


def test_windows_match_one_text_at_a_time():
    model = langid.train(*languages(60))
    texts = ["a", "x" * 256, "the der " * 200, "que"]
    data = [t.encode() for t in texts]
    joined = np.frombuffer(b"".join(data), np.uint8)
    offsets = np.cumsum([0, *map(len, data)])
    p = langid.byte_probabilities(model, joined, offsets)
    for i, d in enumerate(data):
        for low in range(0, len(d), langid.WINDOW):
            part = np.frombuffer(d[low : low + langid.WINDOW], np.uint8)[:, None]
            a, b = slow_states(part, *model.forward, False), slow_states(part, *model.backward, True)
            x = np.exp(a @ model.out[: langid.HIDDEN] + b @ model.out[langid.HIDDEN :] + model.bias)[:, 0]
            assert np.allclose(p[offsets[i] + low : offsets[i] + low + len(part)], x / x.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_id_of_awkward_rows(spark):
    texts, names = languages(60)
    docs = documents(spark, [*AWKWARD, *[(1000 + i, t, n) for i, (t, n) in enumerate(zip(texts, names))]], clash=True)
    got = langid.identify(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert by[100].lang_pred is None and not by[100].accepted and not by[101].accepted and by[101].position_labels is None or len(by[101].position_labels or b"") == 0
    assert len(by[105].position_labels) == len(words(5, 30_000))
    kept = langid.keep_accepted(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.accepted for r in got)
    assert kept.where("doc_id between 1000 and 1059").count() == 60
    assert langid.identify(docs.where(F.lit(False))).collect() == []


def test_model_does_not_depend_on_row_order(spark, monkeypatch):
    texts, names = languages(90)
    docs = documents(spark, [(i % 40 if i % 7 else None, t, n) for i, (t, n) in enumerate(zip(texts, names))])
    for sample in (langid.SAMPLE, 30):
        models = [langid.fit(d, sample) for d in (docs, docs.repartition(5, "text"))]
        for m in models[1:]:
            assert all(np.array_equal(a, b) for a, b in zip((models[0].out, *models[0].forward), (m.out, *m.forward))) and m.margin == models[0].margin
    one = documents(spark, [(1, texts[0], "aa")] * 50)
    assert langid.fit(one, 10).languages == ["aa"]  # all rows hash alike


def test_query_matches_one_text_at_a_time(spark):
    """The whole of identify against a slow network and pooling, row by row."""
    texts, names = languages(60)
    docs = documents(spark, [(i, t, n) for i, (t, n) in enumerate(zip(texts, names))])
    model = langid.fit(docs)
    h = langid.HIDDEN
    for r in langid.identify(docs, model).collect():
        data, every = texts[r.doc_id].encode(), []
        for low in range(0, len(data), langid.WINDOW):
            part = np.frombuffer(data[low : low + langid.WINDOW], np.uint8)[:, None]
            a, b = slow_states(part, *model.forward, False), slow_states(part, *model.backward, True)
            x = np.exp(a @ model.out[:h] + b @ model.out[h:] + model.bias)[:, 0]
            every.append(x / x.sum(axis=1, keepdims=True))
        p = np.concatenate(every)
        assert r.lang_pred == model.languages[p.mean(axis=0).argmax()] and abs(r.confidence - p.mean(axis=0).max()) < 1e-4
        sure = np.sort(p, axis=1)[:, -1] - np.sort(p, axis=1)[:, -2] > 1e-3
        assert (np.frombuffer(bytes(r.position_labels), np.uint8) == p.argmax(axis=1))[sure].all()


def test_language_id_without_labels(spark):
    docs = documents(spark, AWKWARD).withColumn("lang", F.lit(None).cast("string"))
    got = {r.doc_id: r.accepted for r in langid.identify(docs).collect()}
    assert got[103] and not got[100] and not got[101]
    assert langid.keep_accepted(docs).where("text is null").count() == 0


def test_sample_is_bounded_and_stable(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "doc_id")
    a = sorted(r.doc_id for r in sampling.bounded(rows.repartition(7), 500, "doc_id").collect())
    assert len(a) == 500 and a == sorted(r.doc_id for r in sampling.bounded(rows.coalesce(1), 500, "doc_id").collect())
    assert sampling.bounded(rows, 10**6, "doc_id").count() == 20_000
    same = spark.range(3000).selectExpr("id % 2 as doc_id", "id as x")  # all of a key hash alike
    assert sampling.bounded(same, 100, "doc_id").count() == 100


# --- quality


def rated(spark, n: int = 200):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 > 0
        w = [words(i * 997 + j, 1, 900) for j in range(int(rng.integers(20, 120)))]
        text = " ".join(w).capitalize() + "." if good else (" | ".join(w) if i % 8 else " ".join(x + "###" for x in w))
        rows.append((i, text))
        labels.append((i, int(good), 0))
    return documents(spark, [*rows, (5000, None), (5001, ""), (5002, rows[1][1])], clash=True), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_ranking_separates_held_out_documents(spark):
    docs, labels = rated(spark)
    train = labels.where("doc_id < 100")
    got = {r.doc_id: r for r in quality.scored(docs, train, quantile=0.2).collect()}
    good, bad = [got[i].score for i in range(100, 200) if i % 4], [got[i].score for i in range(100, 200) if i % 4 == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.98
    assert got[5000].score is None and not got[5000].keep and not got[5001].keep and got[5002].score == got[1].score
    scores = np.sort([r.score for r in got.values() if r.score is not None])
    limit = scores[math.ceil(0.2 * len(scores)) - 1]
    assert all(r.keep == (r.score >= limit) for r in got.values() if r.score is not None)
    kept = quality.keep_good(docs, train, quantile=0.2)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.keep)


def slow_features(text: str) -> list[float]:
    """The features of one text, with Python's own strings."""
    data, w = text.encode(), [x for x in text.encode().translate(bytes.maketrans(b"\t\n\v\f\r", b"     ")).split(b" ") if x]
    n, size = max(len(w), 1), max(len(data), 1)
    share = lambda chars: sum(c in chars for c in data) / size
    lines = [tuple(line.translate(bytes.maketrans(b"\t\v\f\r", b"    ")).split()) for line in data.split(b"\n")]
    lines = [x for x in lines if x]
    return [
        math.log1p(len(w)), sum(map(len, w)) / n, share(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share(b"0123456789"), share(b"#$%&*+/<=>@\\^_`{|}~[]"), share(b'!?:;"()-'), share(b".,"),
        sum(a == b for a, b in zip(w, w[1:])) / n, len(set(w)) / math.sqrt(n), (len(lines) - len(set(lines))) / max(len(lines), 1), sum(len(x) <= 2 for x in w) / n, sum(len(x) >= 15 for x in w) / n,
    ]


def test_query_matches_slow_version(spark):
    """The whole of op7 on the smallest tables: features by Python, Newton steps on the pairs restated, the quantile by sorting."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").unionByName(documents(spark, [(None, "No id here."), (9001, " \n\t "), (9002, words(5, 30_000))]).select("doc_id", "text"))
    text = {r.doc_id: r.text for r in docs.collect()}
    x = {i: np.array(slow_features(t or "")) for i, t in text.items()}
    rated = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality is not None and text.get(r.doc_id))
    f, good = np.array([x[i] for i, _ in rated]), np.array([q > 0 for _, q in rated])
    model = quality.train(f, good)
    d = np.array([a - b for a in np.clip((f[good] - f.mean(axis=0)) / (f.std(axis=0) + 1e-9), -6, 6) for b in np.clip((f[~good] - f.mean(axis=0)) / (f.std(axis=0) + 1e-9), -6, 6)])
    assert len(d) > quality.PAIRS or np.abs(d.T @ (1 / (1 + np.exp(-d @ model.weights)) - 1) + quality.RIDGE * model.weights).max() < 1e-4
    score = {i: round(float(model.score(v[None])[0]) / quality.GRID) * quality.GRID for i, v in x.items() if text[i]}
    limit = sorted(score.values())[math.ceil(quality.QUANTILE * len(score)) - 1]
    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert set(got) == set(text)
    for i, r in got.items():
        assert (r.score is None and not r.keep) if i not in score else abs(r.score - score[i]) <= quality.GRID + 1e-9
    close = [i for i in score if abs(score[i] - limit) > 2 * quality.GRID]
    assert all(got[i].keep == (score[i] >= limit) for i in close) and len(close) > 0.8 * len(score)


def test_features_do_not_depend_on_neighbours():
    texts = ["one two two.\nline\nline", "", None, "A B C!! | | x9", words(1, 50)]
    together = quality.features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], quality.features(pa.array([t], pa.string()))[0])
    f = dict(zip(quality.FEATURES, together[0]))
    assert math.isclose(f["repeat_word"], 1 / 5) and math.isclose(f["repeat_line"], 1 / 3)


def test_quality_without_pairs(spark):
    docs, labels = rated(spark, 8)
    got = quality.scored(docs, labels.where("quality = 1")).collect()
    assert all(r.score is None for r in got) and sum(r.keep for r in got) == 9
    assert quality.scored(docs, labels.where(F.lit(False))).count() == 11
    assert quality.scored(docs.where(F.lit(False)), labels).collect() == []
    assert quality.keep_good(docs, labels.where("quality = 1")).count() == 9


def test_newton_minimises_the_pairwise_loss():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 3))
    good = x @ np.array([1.0, -2.0, 0.0]) + rng.normal(size=80) > 0
    model = quality.train(x, good)
    z = np.clip((x - model.mean) / model.scale, -6, 6)
    d = (z[good][:, None] - z[~good][None]).reshape(-1, 3)
    loss = lambda w: np.log1p(np.exp(-d @ w)).sum() + quality.RIDGE / 2 * w @ w
    assert all(loss(model.weights) <= loss(model.weights + e) for e in 0.01 * np.concatenate([np.eye(3), -np.eye(3)]))


# --- neighbours


def vectors(spark, x: np.ndarray, extra: list[tuple] = []):
    return spark.createDataFrame([(i, [float(v) for v in r], "c", 3) for i, r in enumerate(x)] + [(*e, "c", 3) for e in extra], "vec_id long, embedding array<float>, list string, part int")


def exact(x: np.ndarray, k: int) -> list[list[int]]:
    d = ann.squared(x.astype(np.float64), x.astype(np.float64))
    np.fill_diagonal(d, np.inf)
    return [np.lexsort((np.arange(len(x)), r))[:k].tolist() for r in d]


def test_copies_of_a_neighbour_from_several_lists_are_one(spark):
    d = np.float32(0.5)
    rows = [(1, [7, 8], [float(d), 0.75]), (1, [7, 9], [float(np.nextafter(d, np.float32(1))), 1.0]), (2, [7], [0.25])]
    got = ann.merged(spark.createDataFrame(rows, "id long, near array<long>, d array<float>"), 3).orderBy("vec_id", "rank").collect()
    assert [(r.vec_id, r.rank, r.neighbour_id) for r in got] == [(1, 1, 7), (1, 2, 8), (1, 3, 9), (2, 1, 7)]
    assert got[0].distance == np.sqrt(0.5)


@pytest.mark.parametrize("shape", ["random", "clustered"])
def test_recall_against_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(ann, "LIST_SIZE", 64)
    monkeypatch.setattr(ann, "PART_SIZE", 50)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(900, 32)).astype(np.float32)
    if shape == "clustered":
        x = (rng.normal(size=(12, 32)) * 4)[rng.integers(0, 12, 900)].astype(np.float32) + x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = ann.neighbours(vectors(spark, x)).toPandas()
    assert got.groupby("vec_id").size().eq(10).all() and got.vec_id.nunique() == 900
    found = got.groupby("vec_id")["neighbour_id"].apply(set)
    assert np.mean([len(found[i] & set(t)) / 10 for i, t in enumerate(exact(x, 10))]) >= 0.9
    r = got.iloc[17]
    assert math.isclose(r.distance, np.linalg.norm(x[int(r.vec_id)] - x[int(r.neighbour_id)]), abs_tol=1e-3)


def test_graph_search_finds_all_lists_in_range():
    rng = np.random.default_rng(0)
    c = np.concatenate([rng.normal(size=(200, 16)), 20 + rng.normal(size=(3, 16))]).astype(np.float32)
    graph = ann.Graph.build(c)
    q = np.concatenate([rng.normal(size=(50, 16)), 20 + rng.normal(size=(5, 16))]).astype(np.float32)
    at, node, _ = graph.search(q, 0.2)
    d = np.sqrt(ann.squared(q, c))
    want = d <= d.min(axis=1, keepdims=True) * 1.2
    got = np.zeros_like(want)
    got[at, node] = True
    assert (got & want).sum() >= 0.97 * want.sum()


def test_awkward_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 4)).astype(np.float32)
    x[3] = x[2]
    nan = float("nan")
    extra = [(100, None), (101, []), (102, [1.0, None, 2.0, 3.0]), (103, [nan, 1.0, 1.0, 1.0]), (104, [1.0, 2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (5, [float(v) for v in x[5]]), (105, [float("inf"), 0.0, 0.0, 0.0])]
    got = ann.neighbours(vectors(spark, x, extra)).collect()
    assert {r.vec_id for r in got} == set(range(8)) and len(got) == 8 * 7
    assert all(next(r for r in got if r.vec_id == a and r.rank == 1).neighbour_id == b for a, b in ((2, 3), (3, 2)))
    assert ann.neighbours(vectors(spark, x).where("vec_id = 1")).collect() == []
    assert ann.neighbours(vectors(spark, x).where(F.lit(False))).collect() == []


def test_ties_go_to_smaller_ids(spark):
    x = np.zeros((30, 3), np.float32)
    x[:, 0] = 1
    got = ann.neighbours(vectors(spark, x), k=4).toPandas().sort_values(["vec_id", "rank"])
    want = [[j for j in range(30) if j != i][:4] for i in range(30)]
    assert got.groupby("vec_id")["neighbour_id"].apply(list).tolist() == want


def test_postings_and_answers_stay_in_proportion_to_the_vectors(spark, monkeypatch):
    """Data without structure: a vector isn't copied to lists in the direction of its own, and a query has one answer from a shard, not one from each list."""
    monkeypatch.setattr(ann, "LIST_SIZE", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x[:20]
    for _ in range(3):
        own = ann.squared(x, c).argmin(axis=1)
        c = np.array([x[own == i].mean(axis=0) for i in range(20)])
    assert len(ann.lists_of(ann.Graph.build(c), x)[0]) < 1.3 * len(x)
    rows = []
    merged = ann.merged
    monkeypatch.setattr(ann, "merged", lambda found, k: (rows.append(found.count()), merged(found, k))[1])
    ann.neighbours(vectors(spark, x))
    assert rows[0] <= len(x) * 2 * spark.sparkContext.defaultParallelism  # there are 57 lists


def test_nearest_centroids_by_cells(monkeypatch):
    rng = np.random.default_rng(2)
    c = ((rng.normal(size=(12, 16)) * 4)[rng.integers(0, 12, 400)] + rng.normal(size=(400, 16))).astype(np.float32)
    q = c[rng.integers(0, 400, 200)] + rng.normal(size=(200, 16)).astype(np.float32) / 4
    want = ann.Graph.build(c).nearest(q)
    monkeypatch.setattr(ann, "FLAT", 0)
    graph = ann.Graph.build(c)
    node, dist = graph.nearest(q)
    assert (np.diff(dist, axis=1) >= 0).all() and all(len(set(r)) == len(r) for r in node)
    assert (node[:, 0] == want[0][:, 0]).mean() >= 0.97
    for ratio in (0.2, np.inf):
        a, b = graph.search(q, ratio), ann.Graph.within(ann.Graph(**(vars(graph) | {"wide": 0.0})), q, ratio)
        assert len(set(zip(*a[:2], strict=True)) & set(zip(*b[:2], strict=True))) >= 0.97 * len(b[0])


def test_shards_find_what_brute_force_finds():
    """Exact within the lists in reach, with many equal vectors, far from the origin, lists longer than a product takes."""
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=(5000, 8)), np.repeat(rng.normal(size=(2, 8)), 400, axis=0)]).astype(np.float32) + np.float32(50)
    rng.shuffle(x)
    ids = np.arange(len(x)) * 3
    graph = ann.Graph.build(x[:2].copy())
    lists = ann.squared(x, graph.centroids).argmin(axis=1)
    order = np.lexsort((ids, lists))
    shard = ann.Shard(graph, lists[order], ids[order], x[order].copy(), 5)
    assert len(shard.ids) < 5100
    q = rng.integers(0, len(x), 300)
    row, near, d = shard.find(ids[q], x[q], np.full(300, np.inf))
    far = ((x[q].astype(np.float64)[:, None] - x[None]) ** 2).sum(axis=2)
    far[np.arange(300), q] = np.inf
    want = [np.lexsort((ids, r))[:5] for r in far]
    assert (near.reshape(300, 5) == ids[want]).all() and np.allclose(d.reshape(300, 5), np.take_along_axis(far, np.array(want), axis=1))


def test_sparse_vectors_among_dense_ones_reach_the_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LIST_SIZE", 32)
    rng = np.random.default_rng(4)
    dense = np.repeat(rng.normal(size=(20, 32)), 100, axis=0) + rng.normal(size=(2000, 32)) / 20
    x = np.concatenate([dense, rng.normal(size=(150, 32))]).astype(np.float32)
    got = ann.neighbours(vectors(spark, x)).toPandas().groupby("vec_id")["neighbour_id"].apply(set)
    recall = np.array([len(got[i] & set(t)) / 10 for i, t in enumerate(exact(x, 10))])
    assert recall[:2000].mean() >= 0.9 and recall[2000:].mean() >= 0.9


def test_queries_are_the_ids_divisible_by_fifty(spark, sf):
    from tidelog.llm import queries

    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas().sort_values("vec_id")
    ids, x = table["vec_id"].to_numpy(), np.stack(table["embedding"].to_numpy())
    got = queries.op8_nearest_neighbours(spark, sf).toPandas().groupby("vec_id")["neighbour_id"].apply(set)
    assert sorted(got.index) == [i for i in ids if i % 50 == 0]
    want = exact(x, 10)
    assert np.mean([len(got[i] & set(ids[want[np.searchsorted(ids, i)]])) / 10 for i in got.index]) >= 0.9
    assert ann.neighbours(vectors(spark, x[:20]).where("vec_id % 50 > 0"), every=50).collect() == []


# --- scratch


def test_scratch_tables_are_cleared(spark):
    import os

    df = scratch.written(spark.range(3).toDF("x"), "mine")
    path = scratch._written[-1]
    assert os.path.isdir(path) and df.count() == 3 and path.startswith(scratch.folder(spark))
    scratch.clear(spark)
    assert not os.path.isdir(path)
    assert isinstance(pd.DataFrame(), pd.DataFrame)
