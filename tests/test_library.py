"""Behaviour of the library on small inputs, against independent statements in Python and pandas."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelog import cli
from tidelog.functions import masking, parsing, predicates, similarity
from tidelog.operators import baseline, batch, comparative, drain, evaluate, parse, reconstruction, samples, synth, tables, temporal
from tidelog.operators import sequence as seq
from tidelog.operators import windows as win
from tidelog.sources import logs
from tidelog.streaming import scorer

LOG = "line_no long, timestamp timestamp_ntz, host string, process string, raw string, template_id string, template string"


def log_of(spark, templates, seconds=None, hosts=None, raws=None):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, None if seconds is None else start + dt.timedelta(seconds=seconds[i]), hosts[i] if hosts else "h", "p", raws[i] if raws else str(t), t, t) for i, t in enumerate(templates)]
    return spark.createDataFrame(rows, LOG)


MASKS = [
    ("at 0x7f8a3c000000", "at <HEX>"), ("from 192.168.1.100", "from <IP>"), ("open /var/log/syslog", "open <PATH>"), ("took 1234 ms", "took <NUM> ms"), ("300.1.2.3", "300.1.2.3"),
    ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "<IP<ID>>"), ("rx/tx", "rx<PATH>"), ("pid=12 uid=3", "pid=<ID> uid=<ID>"), ("한글12", "한글12"), ("eth0 up", "eth<ID> up"), ("-5.5", "<NUM>"), ("00:1B:44:11:3A:B7", "<MAC>"), (None, None), ("", ""),
]


def test_masks(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(MASKS)], "i int, raw string")
    got = {r.i: r.m for r in df.select("i", masking.mask("raw").alias("m")).collect()}
    assert [got[i] for i in range(len(MASKS))] == [b for _, b in MASKS]
    off = df.select("i", masking.mask("raw", masking.MaskConfig(number=False)).alias("m")).where("i = 3").first()
    assert off.m == "took 1234 ms"


def test_parse_shapes(spark):
    lines = ["Sep 14 05:04:41 hostname kernel: [1.2] hello", "[  12.345678] usb 1-1: new device", "  plain text\t", "Feb 29 01:02:03 h p[12]: x", "Sep  4 05:04:41 h-1.x a/b[7]: m: n", "Xyz 14 05:04:41 h p: m", ""]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, value string")
    got = {r.line_no: r for r in parsing.parse(df, 2024).collect()}
    assert (got[0].host, got[0].process, got[0].raw, got[0].timestamp) == ("hostname", "kernel", "[1.2] hello", dt.datetime(2024, 9, 14, 5, 4, 41))
    assert (got[1].host, got[1].raw, got[1].timestamp) == (None, "usb 1-1: new device", None)
    assert got[2].raw == "plain text" and got[6].raw == ""
    assert got[3].host == "h" and got[3].timestamp is None
    assert (got[4].process, got[4].raw, got[4].timestamp.day) == ("a/b", "m: n", 4)
    assert got[5].host == "h" and got[5].timestamp is None


def test_positions_match_a_stable_sort(spark):
    rng = np.random.default_rng(0)
    rows = [(i, None if rng.random() < 0.2 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=int(rng.integers(0, 500))), "h", "p", "r", "t", "t") for i in range(600)]
    rng.shuffle(rows)
    got = {r.line_no: r.pos for r in win.with_position(spark.createDataFrame(rows, LOG)).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    assert got == {r[0]: i for i, r in enumerate(order)}


@pytest.mark.parametrize(("n", "size", "stride"), [(1, 50, 25), (49, 50, 25), (51, 50, 25), (130, 20, 30), (75, 10, 10)])
def test_windows_match_slices(spark, n, size, stride):
    df = spark.range(n).select(F.col("id").alias("pos"))
    got = {}
    for r in win.in_windows(df, size, stride).collect():
        got.setdefault(r.window_idx, []).append(r.pos)
    want = {i: list(range(s, min(s + size, n))) for i, s in enumerate(range(0, n, stride))}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def pandas_ewm(counts: pd.DataFrame, n_windows: int, alpha: float):
    wide = counts.pivot(index="window_idx", columns="code", values="cnt").reindex(range(n_windows)).astype(float)
    return wide.ewm(alpha=alpha, adjust=False).mean(), wide.ewm(alpha=alpha, adjust=False).var(bias=False), wide


@pytest.mark.parametrize("segment", [512, 7])
def test_ewm_equals_pandas_on_sparse_counts(spark, monkeypatch, segment):
    monkeypatch.setattr(baseline, "SEGMENT", segment)
    if segment == 7:
        monkeypatch.setattr(baseline, "HALO", 140)
    rng = np.random.default_rng(0)
    cells = [(w, c, int(rng.integers(1, 30))) for w in range(300) for c in range(4) if rng.random() < (0.9, 0.3, 0.05, 0.5)[c]]
    counts = pd.DataFrame(cells, columns=["window_idx", "code", "cnt"])
    mean, var, _ = pandas_ewm(counts, 300, 0.3)
    for r in baseline.ewm_scores(spark.createDataFrame(counts), 0.3).collect():
        assert abs(r["mean"] - mean.loc[r.window_idx, r.code]) < 1e-9
        v = var.loc[r.window_idx, r.code]
        assert (r.variance is None) == bool(np.isnan(v)) or r.window_idx > 0 and abs((r.variance or 0) - (0 if np.isnan(v) else v)) < 1e-3
        if r.variance is not None and not np.isnan(v):
            assert abs(r.variance - v) < 1e-6 * max(1, v)


def test_one_window_of_new_templates_scores_04(spark):
    row = baseline.detect(log_of(spark, ["a", "b", None, "c"])).collect()
    assert len(row) == 1 and row[0].score == 0.4 and row[0].is_anomaly and row[0].unseen_rate == 1.0
    with pytest.raises(ValueError):
        baseline.detect(log_of(spark, ["a"]).where("line_no < 0"))


def test_constant_scores_flag_everything(spark):
    rows = baseline.detect(log_of(spark, ["a"] * 200), baseline.BaselineParams(50, 50)).collect()
    later = [r for r in rows if r.window_start_line > 0]
    assert all(r.score == later[0].score for r in later)


def test_incremental_lines_stay_unique(spark):
    log = log_of(spark, ["a", "b"])
    both = baseline.merged_log(log, log, log)
    assert sorted(r.line_no for r in both.collect()) == list(range(6))


def test_contexts_cross_blocks(spark, monkeypatch):
    monkeypatch.setattr(win, "BLOCK", 16)
    n = 100
    rows = spark.createDataFrame([(i, None, "h", None if i % 9 == 0 else i) for i in range(n)], "line_no long, timestamp timestamp_ntz, host string, template_index long")
    known = [i for i in range(n) if i % 9]
    monkeypatch.setattr(win.with_blocks, "__defaults__", (16,))
    got = {r.idx: (r.line_no, list(r.context), r.target) for r in win.contexts(rows, 20, keep=5).collect()}
    assert got == {i: (known[i + 20], known[i + 15 : i + 20], known[i + 20]) for i in range(len(known) - 20)}


def test_short_runs_are_padded(spark):
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(3)], "window_idx long, v array<double>")
    row = win.window_sequences(v, 5).collect()
    assert len(row) == 1 and [list(x) for x in row[0].steps] == [[0.0, 1.0], [1.0, 1.0], [2.0, 1.0], [0.0, 0.0], [0.0, 0.0]]


def test_sessions_and_k_of_n_match_a_loop(spark):
    rng = np.random.default_rng(0)
    seconds = np.cumsum(rng.choice([1, 5, 400], 300, p=[0.6, 0.38, 0.02])).tolist()
    hosts = [f"h{i}" for i in rng.integers(0, 3, 300)]
    ok = (rng.random(300) < 0.35).tolist()
    df = log_of(spark, ["t"] * 300, seconds, hosts).withColumn("prediction_ok", F.element_at(F.array(*[F.lit(x) for x in ok]), (F.col("line_no") + 1).cast("int")))
    got = {r.line_no: (r.session_no, r.k_of_n_triggered) for r in seq.k_of_n(seq.with_sessions(df, 300), 7, 10).collect()}
    state: dict[str, tuple] = {}
    for i in range(300):
        last, number, recent = state.get(hosts[i], (None, 0, []))
        if last is not None and seconds[i] - last > 300:
            number, recent = number + 1, []
        recent = [*recent, not ok[i]][-10:]
        assert got[i] == (number, len(recent) == 10 and sum(recent) >= 7 and not ok[i])
        state[hosts[i]] = (seconds[i], number, recent)


def test_cooldown_matches_a_loop(spark):
    rng = np.random.default_rng(1)
    seconds = np.cumsum(rng.integers(0, 50, 200)).tolist()
    sig = [f"s{i}" for i in rng.integers(0, 4, 200)]
    df = log_of(spark, ["t"] * 200, seconds, sig).withColumn("signature", F.col("host"))
    got = sorted(r.line_no for r in seq.cooled(df, F.lit(60)).collect())
    last: dict[str, float] = {}
    want = []
    for i, (t, s) in enumerate(zip(seconds, sig)):
        if s not in last or t - last[s] >= 60:
            want.append(i)
            last[s] = t
    assert got == want


def test_novelty_and_compat(spark):
    log = log_of(spark, ["a", "b"] * 30 + ["new"] + ["a", "b"] * 5, list(range(71)))
    words = spark.createDataFrame([("a", 0), ("b", 1)], "template string, index long")
    model = seq.train(win.contexts(win.encode(log, words), 10, keep=2))
    detail, alerts, summary = seq.infer_enhanced(log, words, model, length=10)
    assert [(r.alert_type, r.line_no) for r in alerts.collect()] == [("NOVELTY", 60)]
    row = summary.first()
    assert row.novel == 1 and row.alerts_by_type == {"NOVELTY": 1}
    assert seq.infer_enhanced(log, words, model, length=10, compat=True)[1].count() == 0
    assert detail.where("prediction_ok").count() == detail.count()


def test_verdicts_read_every_successor(spark):
    """25 templates follow "a" equally often, so 15 of them rank past the tenth."""
    names = [x for i in range(25) for x in ("a", f"t{i:02}")] * 2
    log = log_of(spark, names, list(range(len(names))))
    words = spark.createDataFrame([("a", 0), *[(f"t{i:02}", i + 1) for i in range(25)]], "template string, index long")
    p = win.contexts(win.encode(log, words), 4, keep=2)
    model = seq.train(p)
    got = seq.infer_top_p(p, model, 0.99).where("target > 0").collect()
    assert len(got) == 48 and sum(r.in_topk for r in got) >= 46
    best = seq.predictions(model, 20).where("c1 = 0").first().predicted
    assert len(set(best)) == 20
    assert seq.infer_top_p(p, model, 1.1).where("not in_topk").count() == 0
    detail = seq.infer_enhanced(log, words, model, seq.AlertConfig(top_p=1.1), length=4)[0]
    assert detail.where("not prediction_ok").count() == 0


def test_slow_decay_reads_all_of_the_past(spark):
    x = [100.0] * 400 + [float(3 + i % 7) for i in range(900)]
    got = baseline.ewm_scores(spark.createDataFrame([(i, 0, int(v)) for i, v in enumerate(x)], "window_idx long, code int, cnt long"), 0.01).orderBy("window_idx").toPandas()
    want = pd.Series(x).ewm(alpha=0.01, adjust=False)
    assert abs(got["mean"] - want.mean()).max() < 1e-9
    assert abs(got["variance"] - want.var())[1:].max() < 1e-6


def test_padding_of_missing_predictions(spark):
    log = log_of(spark, ["a", "b"] * 10)
    words = spark.createDataFrame([("a", 0), ("b", 1)], "template string, index long")
    p = win.contexts(win.encode(log, words), 4, keep=2)
    got = seq.infer_top_k(p, seq.train(p), 3).collect()
    assert all(r.in_topk and list(r.predicted)[2] == -1 for r in got) and len(got) == 16
    assert seq.infer_top_k(p.where("idx < 0"), seq.train(p), 3).collect() == []


def test_drain_clusters(spark):
    lines = ["job <NUM> done fast", "job <NUM> done slow", "link up", "job <NUM> done fast", "x1 y1 z", None, "link up"]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, masked string")
    got = {r.line_no: (r.template_id, r.template) for r in drain.mine(df).collect()}
    assert got[0] == ("1", "job <NUM> done fast") and got[1] == ("1", "job <NUM> done <*>") and got[3] == got[1]
    assert got[2][0] == got[6][0] == "2" and got[5] == (None, None) and got[4][0] == "3"
    state = drain.clusters(drain.mine(df))
    assert {r.cluster_id: (list(r.tokens), r["size"]) for r in state.collect()}[1] == (["job", "<NUM>", "done", "<*>"], 3)
    again = drain.mine(spark.createDataFrame([(0, "job <NUM> done late"), (1, "brand new thing")], "line_no long, masked string"), state=state).orderBy("line_no").collect()
    assert [r.template_id for r in again] == ["1", "4"]
    final = {r.line_no: r.template for r in drain.mine_distinct(df).collect()}
    assert final[0] == final[1] == "job <NUM> done <*>" and final[5] is None


def test_drain_in_parallel_numbers_like_one_pass(spark):
    """Messages of many lengths, with odd white space and a state to start from, against a miner that reads them one after the other."""
    rng = np.random.default_rng(4)
    names = ["alpha", "beta", "gamma", "n7", "<NUM>"]
    lines = [" ".join(rng.choice(names, int(rng.integers(0, 9)))).replace(" ", "\u00a0" if i % 11 == 0 else "\x1c" if i % 7 == 0 else "  ") if i % 13 else None for i in range(600)]
    df = spark.createDataFrame(list(enumerate(lines)), "line_no long, masked string").repartition(5)
    state = drain.clusters(drain.mine(df.where("line_no < 60")))
    known = [(r.cluster_id, list(r.tokens), r["size"]) for r in state.collect()]
    for start, got in (([], drain.mine(df)), (known, drain.mine(df, state=state))):
        miner, want = drain.Miner(clusters=start), []
        for i, text in enumerate(lines):
            c = miner.add(text) if text is not None else None
            want.append((i, text, c and str(c.number), c and " ".join(c.tokens)))
        assert [tuple(r) for r in got.orderBy("line_no").collect()] == want


def test_drain_by_source_is_independent(spark):
    df = spark.createDataFrame([(i, f"s{i % 2}", f"alpha beta {i % 2} gamma") for i in range(10)], "line_no long, source string, masked string")
    assert {r.template_id for r in drain.mine(df, source="source").collect()} == {"1"}


def test_similarity_rules(spark):
    vocabulary = spark.createDataFrame([("disk failed on node", 0), ("disk failed on node", 1), ("user logged in", 2)], "template string, index long")
    lines = spark.createDataFrame([(0, "disk failed on host"), (1, "user logged out"), (2, "zzz"), (3, "")], "line_no long, masked string")
    got = {r.line_no: r.predicted for r in similarity.nearest_template(lines, vocabulary).collect()}
    assert got == {0: 0, 1: 2, 2: -1, 3: -1}


def test_temporal_unseen_hours_without_timestamps(spark):
    log = log_of(spark, ["a", "b"])
    assert temporal.analyze(log).collect() == []


def test_comparison_of_equal_distributions(spark):
    d = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "key string, share double")
    row = comparative.compare(d, d).first()
    assert abs(row.kl_divergence) < 1e-12 and row.jaccard_similarity == 1.0 and row.common_templates == 2
    empty = comparative.compare(d.where("share > 1"), d.where("share > 1")).first()
    assert empty.kl_divergence == 0.0 and empty.jaccard_similarity == 0.0


def test_quality_rules(spark):
    good = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), "h", "p", "fine", f"t{i % 12}", "x", "good") for i in range(240)]
    bad = [(i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=2 * i), "h", "p", "error" if i % 2 else "warn", "t", "x", "bad") for i in range(20)]
    df = spark.createDataFrame(good + bad, LOG + ", source string")
    got = {r.source: r for r in comparative.quality(df).collect()}
    assert got["good"].valid and got["good"].score == 1.0 and got["good"].issues == []
    assert not got["bad"].valid and got["bad"].score == 0.0 and set(got["bad"].issues) == {"high_error_rate", "high_warning_rate", "few_templates", "few_lines", "low_entropy", "time_gaps"}
    assert comparative.quality_summary(comparative.quality(df)).first().recommended == ["good"]
    assert batch.choose_target(df) == "good"


def test_thresholds_match_numpy(spark):
    rng = np.random.default_rng(0)
    e = rng.gamma(2, 1, 500)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(e)], "window_idx long, reconstruction_error double")
    r = reconstruction.threshold_stats(df).first()
    med = np.median(e)
    want = {"threshold_95": np.percentile(e, 95), "threshold_99": np.percentile(e, 99), "threshold_99_9": np.percentile(e, 99.9), "threshold_3sigma": e.mean() + 3 * e.std(), "threshold_mad": med + 3 * 1.4826 * np.median(np.abs(e - med))}
    assert all(abs(r[k] - v) < 1e-9 for k, v in want.items())
    starts = df.select("window_idx", F.col("window_idx").alias("start_index"))
    on = lambda **kw: reconstruction.detect(df, starts, reconstruction.threshold_stats(df), **kw).where("is_anomaly").count()
    assert on(threshold=float(e.max())) == 0 and on(method="nonsense") == on(method="99percentile") == 5


def test_pca_residual_matches_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "window_idx long, v array<double>")
    model = reconstruction.fit_pca(df, 2)
    _, _, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = ((x - x @ vt[:2].T @ vt[:2]) ** 2).mean(axis=1)
    got = {r.window_idx: r.reconstruction_error for r in reconstruction.pca_errors(df, model).collect()}
    assert max(abs(got[i] - want[i]) for i in got) < 1e-8


def test_precision_of_nothing_is_zero(spark):
    df = spark.createDataFrame([(False, False)], "is_anomaly boolean, truth boolean")
    r = evaluate.precision_recall(df).first()
    assert (r.precision, r.recall, r.f1, r.tn) == (0.0, 0.0, 0.0, 1)


def test_quality_score_bands(spark):
    df = spark.createDataFrame([(0, 0, 3, 3, 1.0, 1.0, 500), (1, 1, 0, 3, 0.0, 0.0, 3000)], "required_missing int, corrupted int, loadable int, models int, mean_f1 double, success_rate double, max_memory_mb int")
    assert [(r.score, r.band) for r in evaluate.quality_score(df).collect()] == [(100.0, "excellent"), (5.0, "poor")]


def test_severity_ladders(spark):
    r = spark.range(1).select(predicates.reconstruction_severity(F.lit(4.0), F.lit(1.0)).alias("a"), predicates.reconstruction_severity(F.lit(4.0), F.lit(0.0)).alias("b"), predicates.deeplog_severity(F.lit(0.5)).alias("c"), predicates.is_error(F.lit(None).cast("string")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == ("high", "medium", "high", False)


def test_text_scan_numbers_lines_across_splits(spark, tmp_path):
    (tmp_path / "a").mkdir()
    lines = [f"line {i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "a" / "one.log").write_bytes(("\n".join(lines) + "\n").encode() + b"bad \xff byte\n")
    (tmp_path / "a" / "two.log").write_text("only\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = logs.read_lines(spark, str(tmp_path / "a")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    one = sorted((r.line_no, r.value) for r in got if r.path.endswith("one.log"))
    assert one == [*enumerate(lines), (5000, "bad  byte")]
    assert [(r.line_no, r.value) for r in got if r.path.endswith("two.log")] == [(0, "only")]


def test_discovery_rules(spark, tmp_path):
    for name, size in (("a.log", 5), ("b.txt", 9), ("empty.log", 0), ("skip.bin", 3), ("d1/c.log", 7), (".hidden/x.log", 4), ("d1/d2/d3/d4/deep.log", 4)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    got = [r.path.rsplit("/", 1)[1] for r in logs.discover(spark, str(tmp_path)).collect()]
    assert got == ["b.txt", "c.log", "a.log"]


def test_format_sniff(spark):
    lines = {"iso": "2024-01-01T10:00:00 x", "bracket": "[2024-01-01 10:00:00] x", "apache": '1.2.3.4 - - [10/Oct/2000] "GET"', "json": '{"a": 1}', "generic": "hello", "blank": "  "}
    df = spark.createDataFrame([(k, 0, v) for k, v in lines.items()], "path string, line_no long, value string")
    got = {r.path: r.format for r in logs.sniff(df).collect()}
    assert got == {"iso": "timestamp_iso", "bracket": "timestamp_bracket", "apache": "apache_combined", "json": "json", "generic": "generic", "blank": "unknown"}


def test_json_results_are_escaped(spark):
    row = logs.result_lines(spark.createDataFrame([('say "hi"\n',)], "log_line string")).first()
    assert row.value == '{"log_line":"say \\"hi\\"\\n"}'


def test_generators_repeat_and_hit_their_rate(spark):
    a, b = (synth.generate(spark.newSession(), 4000, 0.05).orderBy("line_no").collect() for _ in range(2))
    assert a == b and 120 < sum(r.is_anomaly for r in a) < 280
    assert all(re.match(r"[A-Z][a-z]{2} \d+ \d\d:\d\d:\d\d host\d app\d: \S", r.value) and "{" not in r.value for r in a)
    assert synth.training(spark, 500).where("is_anomaly = 1").count() == 0
    kinds = {r.anomaly_type for r in synth.inference_anomaly(spark).collect()}
    assert kinds == {None, "unseen", "error", "attack", "crash", "burst"}


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(f"k{i % 3}", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), None if rng.random() < 0.1 else int(rng.integers(0, 4))) for i in range(300)]
    schema = "key string, line_no long, timestamp timestamp, template_index long"
    df = spark.createDataFrame(rows, schema)
    for part in range(3):
        df.where(f"line_no div 100 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = scorer.contexts(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.schema(scorer.CONTEXTS).parquet(str(tmp_path / "out"))
    assert len(got.select("line_no").distinct().collect()) == 300
    want = scorer.batch_contexts(df)
    columns = ["key", "line_no", "template_index", "c2", "c1", "seen"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_changed_files_are_debounced(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    rows = [("/m/a.pth", at), ("/m/a.pth", at + dt.timedelta(seconds=20)), ("/m/b.pth", at)]
    spark.createDataFrame(rows, "path string, modificationTime timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, modificationTime timestamp").parquet(str(tmp_path / "in"))
    q = scorer.changed_files(stream).writeStream.format("memory").queryName("changed").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.name for r in spark.table("changed").collect()) == ["a.pth", "b.pth"]


def test_command_line_end_to_end(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    run = lambda *argv: cli.main(list(argv), spark)
    run("gen-inference-anomaly", "--output", at("raw"), "--labels", at("labels"), "--lines", "1200", "--rate", "0.05")
    run("hybrid-pipeline", "--input", at("raw"), "--output", at("all"), "--year", "2024")
    p = at("all/parsed")
    assert spark.read.parquet(p).columns == list(parse.COLUMNS) and spark.read.parquet(p).count() == 1200
    assert spark.read.parquet(p).where("timestamp is null").count() == 0
    run("deeplog-infer", "--sequences", at("all/sequences"), "--model", at("all/sequence_model"), "--output", at("verdicts"))
    run("deeplog-infer-enhanced", "--parsed", p, "--vocab", at("all/vocab"), "--model", at("all/sequence_model"), "--output", at("enhanced"))
    run("mscred-infer", "--counts", at("all/counts"), "--model", at("all/window_model"), "--output", at("windows"))
    run("report", "--scores", at("all/scores"), "--sequences", at("verdicts"), "--windows", at("windows"), "--output", at("report.md"))
    assert "| baseline | 48 |" in open(at("report.md")).read()
    run("eval", "--scores", at("all/scores"), "--sequences", at("verdicts"), "--labels", at("labels"), "--output", at("eval"))
    assert spark.read.parquet(at("eval")).count() == 2
    run("analyze-samples", "--parsed", p, "--scores", at("all/scores"), "--output", at("samples"))
    run("analyze-temporal", "--parsed", p, "--output", at("temporal"))
    run("analyze-comparative", "--parsed", f"{p},{p}", "--output", at("comparative"), "--target", p)
    run("analyze-mscred", "--windows", at("windows"), "--counts", at("all/counts"), "--scores", at("all/scores"), "--output", at("mscred"))
    run("validate-baseline", "--parsed", p, "--output", at("quality"))
    assert spark.read.parquet(at("quality/files")).count() == 1
    assert len(cli.COMMANDS) == 22


def test_sample_helpers(spark):
    log = log_of(spark, [f"t{i % 3}" for i in range(60)], list(range(60)), raws=["error" if i % 10 == 0 else "ok" for i in range(60)])
    spaced = sorted(r.line_no for r in samples.spaced_samples(log, predicates.is_error("raw"), 3).collect())
    assert spaced == [0, 20, 50]
    assert samples.histogram(log.select(F.col("line_no").cast("double").alias("x")), "x", 6).orderBy("bin").collect()[-1].n == 10
    assert samples.template_samples(log, spark.createDataFrame([("t1",)], "template_id string"), 2).count() == 2


@pytest.mark.parametrize("n", [1, 2, 7, 400, 50_000])
def test_quantiles_are_exact(spark, n):
    rng = np.random.default_rng(n)
    for values in (rng.normal(size=n), np.round(rng.exponential(size=n), 1)):
        df = spark.createDataFrame(pd.DataFrame({"x": values})).unionByName(spark.createDataFrame([(None,)], "x double")).repartition(3)
        shares = {f"q{i}": q for i, q in enumerate((0.0, 0.5, 0.5001, 0.95, 0.999, 1.0))}
        got = tables.quantiles(df, "x", shares).first()
        assert all(np.isclose(got[name], np.quantile(values, q), rtol=1e-12) for name, q in shares.items())
        assert np.isclose(tables.quantile(df, "x", 0.95, "v").first().v, got.q3, rtol=0)
    assert tables.quantile(df.where("x is null"), "x", 0.5, "v").first().v is None


def test_contexts_that_were_never_trained_use_shorter_ones(spark):
    log = log_of(spark, ["a", "b", "c"] * 8 + ["c", "b", "a", "d", "a"], list(range(29)))
    words = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2), ("d", 3)], "template string, index long")
    p = win.contexts(win.encode(log, words), 3, keep=2)
    model = seq.train(p.where("line_no < 24"))  # a b c a b c: after b comes c, after c comes a
    for got in (seq.infer_top_k(p, model, 1), seq.infer_top_p(p, model, 0.9)):
        ok = {r.line_no: r.in_topk for r in got.collect()}
        # 25 is b after "c c" (c knows only a), 26 is a after "c b" (b knows only c), 27 is d, 28 is a after "a d" (d is new: the most frequent)
        assert [ok[i] for i in range(23, 29)] == [True, False, False, False, False, seq.infer_top_k(p, model, 1).where("line_no = 28").first().predicted[0] == 0]
    assert seq.infer_top_k(p, model, 1).where("line_no = 25").first().predicted == [0]
    assert seq.infer_top_k(p, model, 4).where("line_no = 28").first().predicted[3] == -1
