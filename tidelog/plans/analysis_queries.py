"""Evaluation, reconstruction, samples, reports and diagnostics over the events log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import autoencoder, evaluate, samples
from ..operators import reconstruction as recon
from ..operators import windows as win
from ..operators.tables import written
from ..sources import logs
from ..sources.adapters import events_log
from .baseline_queries import _DENSE, scores, vectors, windowed, zscores
from .registry import FEATURES, LOGS, SCORES, WINDOWED, query
from .sequence_queries import TOPK, pairs, trained
from .source_queries import sources

#: lines 101, 302, 503 ... and the ten after each are labelled anomalous
LABELS = "labelled AS (SELECT line_no, CASE WHEN line_no % 201 >= 101 AND line_no % 201 <= 111 AND line_no % 5 <> 0 THEN 1 ELSE 0 END AS is_anomaly FROM logs)"


def labels(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("line_no")
    return events_log(spark, sf).select("line_no", ((n % 201 >= 101) & (n % 201 <= 111) & (n % 5 != 0)).cast("int").alias("is_anomaly"))


def _prf(p: str, t: str) -> str:
    c = lambda x: f"count(*) FILTER ({x})"
    tp, fp, fn, tn = c(f"{p} AND {t}"), c(f"{p} AND NOT {t}"), c(f"NOT {p} AND {t}"), c(f"NOT {p} AND NOT {t}")
    pr, re = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return f"{tp} AS tp, {fp} AS fp, {fn} AS fn, {tn} AS tn, round({pr}, 7) AS precision, round({re}, 7) AS recall, round(coalesce(2 * {pr} * {re} / nullif({pr} + {re}, 0), 0), 7) AS f1"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 7) for c in ("precision", "recall", "f1")})


_TRUTH = f"{LABELS}, judged AS (SELECT s.*, EXISTS (SELECT 1 FROM labelled l WHERE l.is_anomaly = 1 AND l.line_no >= window_start_line AND l.line_no < window_start_line + 50) AS truth FROM scores s)"


@query("e1_window_labels", f"WITH RECURSIVE {SCORES}, {_TRUTH} SELECT window_start_line, is_anomaly, truth FROM judged")
def e1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.label_windows(scores(spark, sf), labels(spark, sf)).select("window_start_line", "is_anomaly", "truth")


@query("e3_baseline_evaluation", f"WITH RECURSIVE {SCORES}, {_TRUTH} SELECT {_prf('is_anomaly', 'truth')} FROM judged")
def e3(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.evaluate_baseline(scores(spark, sf), labels(spark, sf)))


@query("e4_sequence_evaluation", f"WITH {TOPK}, {LABELS}, j AS (SELECT NOT in_topk AS p, is_anomaly = 1 AS t FROM verdict JOIN labelled USING (line_no)) SELECT {_prf('p', 't')} FROM j")
def e4(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import sequence as seq

    p = pairs(spark, sf)
    return _rounded(evaluate.evaluate_sequences(seq.infer_top_k(p, trained(p), 3), labels(spark, sf)))


ERRORS = WINDOWED + f""", {_DENSE},
errs AS (SELECT window_idx, round(avg(z * z), 9) AS reconstruction_error, any_value(start_index) AS start_index FROM zs JOIN starts USING (window_idx) GROUP BY window_idx)"""
FOUND = ERRORS + """,
lim AS (SELECT quantile_cont(reconstruction_error, 0.95) AS threshold FROM errs),
found AS (SELECT errs.*, reconstruction_error > threshold AS is_anomaly, threshold FROM errs, lim)"""


def errors(spark: SparkSession, sf: str) -> DataFrame:
    """Mean squared standardised counts: the error of a model that always predicts the mean window."""
    return zscores(spark, sf).groupBy("window_idx").agg(F.round(F.avg(F.col("z") * F.col("z")), 9).alias("reconstruction_error"))


def found(spark: SparkSession, sf: str) -> DataFrame:
    return recon.detect(errors(spark, sf), win.window_starts(windowed(spark, sf)))


@query("e7_block_accuracy", f"WITH {FOUND}, {LABELS}, b AS (SELECT line_no // 50 AS window_idx, max(is_anomaly) = 1 AS t FROM labelled GROUP BY ALL), j AS (SELECT is_anomaly AS p, t FROM found JOIN b USING (window_idx)) SELECT {_prf('p', 't')} FROM j")
def e7(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(evaluate.evaluate_by_block(found(spark, sf), labels(spark, sf)))


@query(
    "e5_model_comparison",
    f"""WITH RECURSIVE {FEATURES}, {_DENSE}, errs AS (SELECT window_idx, avg(z * z) AS e FROM zs GROUP BY window_idx),
    m AS (SELECT 'mscred' AS method, avg((e > 1.0)::INT) AS rate_1, avg((e > 1.2)::INT) AS rate_2 FROM errs UNION ALL SELECT 'baseline', avg((freq_z > 0.8)::INT), avg((freq_z > 0.81)::INT) FROM features)
    SELECT method, round(rate_1, 7) AS rate_1, round(rate_2, 7) AS rate_2, round(rate_2 - rate_1, 7) AS rate_diff, CASE WHEN abs(rate_2 - rate_1) < 0.01 THEN 'similar' WHEN abs(rate_2 - rate_1) < 0.05 THEN 'slightly different' ELSE 'different' END AS verdict FROM m""",
)
def e5(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import baseline as base

    e, f = errors(spark, sf), base.window_features(events_log(spark, sf))
    at = lambda a, b: evaluate.method_results({"mscred": e.select((F.col("reconstruction_error") > a).alias("flag"), F.col("reconstruction_error").alias("score")), "baseline": f.select((F.col("freq_z") > b).alias("flag"), F.col("freq_z").alias("score"))})
    out = evaluate.compare_models(at(1.0, 0.8), at(1.2, 0.81))
    return out.select("method", *[F.round(c, 7).alias(c) for c in ("rate_1", "rate_2", "rate_diff")], "verdict")


@query("e6_file_integrity", f"WITH {LOGS}, h AS (SELECT DISTINCT 'host=' || host AS name FROM logs), x AS (SELECT unnest(['host=h0', 'host=h1', 'host=h9']) AS name, unnest([true, false, true]) AS required) SELECT x.name, required, h.name IS NOT NULL AS present FROM x LEFT JOIN h USING (name)")
def e6(spark: SparkSession, sf: str) -> DataFrame:
    files = events_log(spark, sf).groupBy(F.concat(F.lit("/model/host="), "host").alias("path")).agg(F.count("*").alias("length"))
    return logs.integrity(files, [("host=h0", True), ("host=h1", False), ("host=h9", True)]).select("name", "required", "present")


@query("e8_quality_score", "SELECT l_returnflag AS model, round(20.0 + 20.0 + 30 * avg(l_discount) * 10 + 20 * avg(l_tax) * 10 + 10, 6) AS score FROM lineitem GROUP BY l_returnflag")
def e8(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.adapters import table

    checks = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.lit(0).alias("required_missing"), F.lit(0).alias("corrupted"), F.lit(3).alias("loadable"), F.lit(3).alias("models"),
        (F.avg("l_discount") * 10).alias("mean_f1"), (F.avg("l_tax") * 10).alias("success_rate"), F.lit(500).alias("max_memory_mb"),
    )
    return evaluate.quality_score(checks).select("model", F.round("score", 6).alias("score"))


_STATS = """t AS (SELECT quantile_cont(reconstruction_error, 0.95) AS threshold_95, quantile_cont(reconstruction_error, 0.99) AS threshold_99, quantile_cont(reconstruction_error, 0.999) AS threshold_99_9,
  avg(reconstruction_error) AS mean, stddev_pop(reconstruction_error) AS std, quantile_cont(reconstruction_error, 0.5) AS median FROM errs),
d AS (SELECT quantile_cont(abs(reconstruction_error - median), 0.5) AS mad FROM errs, t)"""


@query("m5_threshold_stats", f"WITH {ERRORS}, {_STATS} SELECT round(threshold_95, 6) AS threshold_95, round(threshold_99, 6) AS threshold_99, round(threshold_99_9, 6) AS threshold_99_9, round(mean + 3 * std, 6) AS threshold_3sigma, round(median + 3 * 1.4826::DOUBLE * mad, 6) AS threshold_mad, round(mad, 6) AS mad FROM t, d")
def m5(spark: SparkSession, sf: str) -> DataFrame:
    return recon.threshold_stats(errors(spark, sf)).select(*[F.round(c, 6).alias(c) for c in ("threshold_95", "threshold_99", "threshold_99_9", "threshold_3sigma", "threshold_mad", "mad")])


@query("m6_detect_by_method", f"WITH {ERRORS}, {_STATS}, x AS (SELECT window_idx, start_index, reconstruction_error, threshold_99 AS a, mean + 3 * std AS b, median + 3 * 1.4826::DOUBLE * mad AS c FROM errs, t, d) SELECT window_idx, start_index, reconstruction_error > a AS by_99, reconstruction_error > b AS by_3sigma, reconstruction_error > c AS by_mad, reconstruction_error > 1.0 AS by_hand FROM x")
def m6(spark: SparkSession, sf: str) -> DataFrame:
    e, starts = errors(spark, sf), win.window_starts(windowed(spark, sf))
    stats = recon.threshold_stats(e)
    out = None
    for name, args in (("by_99", {"method": "99percentile"}), ("by_3sigma", {"method": "3sigma"}), ("by_mad", {"method": "mad"}), ("by_hand", {"threshold": 1.0})):
        one = recon.detect(e, starts, stats, **args).select("window_idx", "start_index", F.col("is_anomaly").alias(name))
        out = one if out is None else out.join(one.drop("start_index"), "window_idx")
    return out


@query("m7_sequence_starts", f"WITH {WINDOWED} SELECT window_idx, start_index FROM starts WHERE window_idx <= (SELECT max(window_idx) - 19 FROM starts)")
def m7(spark: SparkSession, sf: str) -> DataFrame:
    steps = win.window_sequences(vectors(spark, sf), 20)
    return steps.select("window_idx").join(win.window_starts(windowed(spark, sf)), "window_idx")


@query("m3_mean_squared_error", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: (x::DOUBLE - 0.125) ** 2)) / len(embedding), 7) AS mse FROM embeddings")
def m3(spark: SparkSession, sf: str) -> DataFrame:
    from ..sources.adapters import table

    v = F.col("embedding").cast("array<double>")
    flat = F.transform(v, lambda x: F.lit(0.125))
    return table(spark, sf, "embeddings").select("vec_id", F.round(recon.mean_squared_error(v, flat), 7).alias("mse"))


@query("m8_pca_reconstruction")
def m8(spark: SparkSession, sf: str) -> DataFrame:
    steps = win.window_sequences(vectors(spark, sf), 20).select("window_idx", F.flatten("steps").alias("v"))
    train, held = recon.split(steps)
    model = recon.fit_pca(train, 8)
    stats = recon.threshold_stats(recon.pca_errors(held, model))
    return recon.detect(recon.pca_errors(steps, model), win.window_starts(windowed(spark, sf)), stats)


@query("x1_error_stats", f"WITH {FOUND} SELECT count(*) AS total_windows, count(*) FILTER (is_anomaly) AS anomalous_windows, round(avg(is_anomaly::INT), 7) AS anomaly_rate, round(avg(reconstruction_error), 6) AS mean, round(stddev_samp(reconstruction_error), 6) AS std, round(min(reconstruction_error), 6) AS min, round(max(reconstruction_error), 6) AS max, round(quantile_cont(reconstruction_error, 0.5), 6) AS median, round(quantile_cont(reconstruction_error, 0.75), 6) AS q75, round(quantile_cont(reconstruction_error, 0.95), 6) AS q95, round(quantile_cont(reconstruction_error, 0.99), 6) AS q99 FROM found")
def x1(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.error_stats(found(spark, sf))
    return out.withColumns({c: F.round(c, 7 if c == "anomaly_rate" else 6) for c in out.columns[2:]})


@query(
    "x2_anomaly_patterns",
    f"""WITH {FOUND}, a AS (SELECT window_idx, start_index, reconstruction_error FROM found WHERE is_anomaly ORDER BY window_idx LIMIT 20),
    c AS (SELECT window_idx, code, cnt, row_number() OVER (PARTITION BY window_idx ORDER BY cnt DESC, code) AS r FROM counts)
    SELECT a.window_idx, any_value(start_index) AS start_index, round(any_value(reconstruction_error), 6) AS reconstruction_error, CAST(sum(cnt) AS BIGINT) AS total_logs, count(*) AS unique_templates, string_agg('t' || code || ':' || cnt, ',' ORDER BY r) FILTER (r <= 5) AS top_templates FROM a JOIN c USING (window_idx) GROUP BY a.window_idx""",
)
def x2(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.anomaly_patterns(found(spark, sf), win.window_counts(windowed(spark, sf)))
    return out.withColumns({"reconstruction_error": F.round("reconstruction_error", 6), "top_templates": F.array_join("top_templates", ",")})


@query(
    "x3_method_overlap",
    f"WITH RECURSIVE {SCORES}, {_DENSE}, errs AS (SELECT window_idx, round(avg(z * z), 9) AS e FROM zs GROUP BY window_idx), m AS (SELECT window_idx FROM errs WHERE e > (SELECT quantile_cont(e, 0.95) FROM errs)), b AS (SELECT DISTINCT window_start_line // 25 AS window_idx FROM scores WHERE is_anomaly), f AS (SELECT m.window_idx AS m, b.window_idx AS b FROM m FULL JOIN b USING (window_idx)) SELECT count(*) FILTER (b IS NULL) AS mscred_only, count(*) FILTER (m IS NULL) AS baseline_only, count(*) FILTER (m IS NOT NULL AND b IS NOT NULL) AS both_methods, round(count(*) FILTER (m IS NOT NULL AND b IS NOT NULL) / count(*), 7) AS overlap_ratio FROM f",
)
def x3(spark: SparkSession, sf: str) -> DataFrame:
    return samples.method_overlap(found(spark, sf), scores(spark, sf)).withColumn("overlap_ratio", F.round("overlap_ratio", 7))


_BAD = "regexp_matches(raw, '(?i)error|fail|exception|warning|critical')"
_RECON = f"""top AS (SELECT window_idx, start_index, reconstruction_error, threshold FROM found WHERE is_anomaly ORDER BY reconstruction_error DESC, window_idx LIMIT 10),
rl AS (SELECT top.*, raw, template_id FROM top JOIN logs ON line_no >= start_index AND line_no < start_index + 50)"""


@query("x4_l7_reconstruction_samples", f"WITH {FOUND}, {_RECON} SELECT window_idx, start_index, round(any_value(reconstruction_error / threshold), 6) AS error_ratio, CASE WHEN any_value(reconstruction_error / threshold) >= 3 THEN 'high' WHEN any_value(reconstruction_error / threshold) >= 1.5 THEN 'medium' ELSE 'low' END AS severity, count(*) AS n_lines, round(avg({_BAD}::INT), 7) AS error_rate, count(DISTINCT template_id) AS unique_templates FROM rl GROUP BY window_idx, start_index")
def x4(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.reconstruction_samples(found(spark, sf), events_log(spark, sf), 10)
    return out.select("window_idx", "start_index", F.round("error_ratio", 6).alias("error_ratio"), "severity", "n_lines", F.round("error_rate", 7).alias("error_rate"), "unique_templates")


@query("x5_error_histogram", f"WITH {ERRORS}, e AS (SELECT min(reconstruction_error) AS lo, max(reconstruction_error) AS hi FROM errs) SELECT CAST(least(floor((reconstruction_error - lo) / (hi - lo) * 50), 49) AS BIGINT) AS bin, count(*) AS n FROM errs, e GROUP BY ALL")
def x5(spark: SparkSession, sf: str) -> DataFrame:
    return samples.histogram(errors(spark, sf), "reconstruction_error", 50)


_TOP = """top AS (SELECT * FROM scores WHERE is_anomaly ORDER BY score DESC, window_start_line LIMIT 20)"""


@query("l1_baseline_sample_lines", f"WITH RECURSIVE {SCORES}, {_TOP} SELECT window_start_line AS anchor, line_no, raw, line_no >= window_start_line AND line_no < window_start_line + 50 AS is_anchor FROM top JOIN logs ON line_no BETWEEN window_start_line - 3 AND window_start_line + 52")
def l1(spark: SparkSession, sf: str) -> DataFrame:
    return samples.window_lines(events_log(spark, sf), samples.top_anomalies(scores(spark, sf))).select("anchor", "line_no", "raw", "is_anchor")


def _sample(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    chosen = samples.top_anomalies(scores(spark, sf))
    lines = samples.window_lines(events_log(spark, sf), chosen, 50, 0)
    return lines, chosen.select(F.col("window_start_line").alias("anchor"), "unseen_rate", "freq_z")


_LINES = """sl AS (SELECT window_start_line AS anchor, unseen_rate, freq_z, logs.* FROM top JOIN logs ON line_no >= window_start_line AND line_no < window_start_line + 50),
st AS (SELECT anchor, template_id, count(*) AS n, min(line_no) AS first FROM sl GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY n DESC, first) AS r FROM st)"""


@query(
    "l2_window_patterns",
    f"""WITH RECURSIVE {SCORES}, {_TOP}, {_LINES}, b AS (SELECT anchor, count(*) AS n_lines, count(*) FILTER (regexp_matches(raw, '(?i)error|fail|exception|panic|fatal|crash')) AS error_log_count, count(DISTINCT template_id) AS unique_templates, any_value(unseen_rate) AS u, any_value(freq_z) AS z,
      (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS d FROM sl GROUP BY anchor),
    g AS (SELECT anchor, string_agg(template_id || ':' || n, ',' ORDER BY r) FILTER (r <= 3) AS dominant_templates FROM sr GROUP BY anchor)
    SELECT anchor, n_lines, error_log_count, unique_templates, round(error_log_count / n_lines * 100, 6) AS error_percentage, round(n_lines / greatest(d, 1), 6) AS logs_per_second, dominant_templates,
      array_to_string(list_filter([CASE WHEN u > 0.2 THEN 'high_unseen_rate' END, CASE WHEN z > 2 THEN 'frequency_spike' END, CASE WHEN error_log_count > 0 THEN 'errors_found' END, CASE WHEN unique_templates > 0.8 * n_lines THEN 'high_diversity' END], lambda x: x IS NOT NULL), ',') AS anomaly_indicators FROM b JOIN g USING (anchor)""",
)
def l2(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.window_patterns(*_sample(spark, sf))
    shown = F.array_join(F.transform("dominant_templates", lambda x: F.concat_ws(":", x["template_id"], x["count"].cast("string"))), ",")
    return out.select("anchor", "n_lines", "error_log_count", "unique_templates", F.round("error_percentage", 6).alias("error_percentage"), F.round("logs_per_second", 6).alias("logs_per_second"), shown.alias("dominant_templates"), F.array_join("anomaly_indicators", ",").alias("anomaly_indicators"))


@query(
    "l3_representatives",
    f"""WITH RECURSIVE {SCORES}, {_TOP}, {_LINES}, x AS (
      SELECT anchor, 'dominant_template' AS type, first AS line_no FROM sr WHERE r = 1
      UNION ALL SELECT anchor, 'error_log', min(line_no) FROM sl WHERE regexp_matches(raw, '(?i)error|fail|exception') GROUP BY anchor
      UNION ALL SELECT anchor, 'rare_template', min(first) FROM st WHERE n = 1 GROUP BY anchor)
    SELECT anchor, type, line_no, raw FROM x JOIN logs USING (line_no)""",
)
def l3(spark: SparkSession, sf: str) -> DataFrame:
    return samples.representatives(_sample(spark, sf)[0])


@query("l4_time_density", f"WITH RECURSIVE {SCORES}, {_TOP}, {_LINES}, g AS (SELECT anchor, (epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY anchor ORDER BY timestamp, line_no)) / 1e6 AS gap FROM sl) SELECT anchor, round(avg(gap), 4) AS average_interval_seconds, CASE WHEN stddev_samp(gap) < 0.5 * avg(gap) THEN 'concentrated' ELSE 'spread' END AS time_distribution FROM g GROUP BY anchor")
def l4(spark: SparkSession, sf: str) -> DataFrame:
    return samples.window_patterns(*_sample(spark, sf)).select("anchor", F.round("average_interval_seconds", 4).alias("average_interval_seconds"), "time_distribution")


_ALERTS = """alerts AS (SELECT CAST(line_no AS VARCHAR) AS alert_id, CASE WHEN line_no % 3 = 0 THEN line_no ELSE -1 END AS l, CASE WHEN line_no % 3 = 1 THEN timestamp END AS t, host FROM logs WHERE line_no % 500 < 3)"""


@query("l5_alert_location", f"WITH {LOGS}, {_ALERTS}, ft AS (SELECT timestamp, min(line_no) AS b FROM logs GROUP BY ALL), fh AS (SELECT host, min(line_no) AS c FROM logs GROUP BY ALL) SELECT alert_id, coalesce(logs.line_no, b, c) AS located_line, CASE WHEN logs.line_no IS NOT NULL THEN 'line' WHEN b IS NOT NULL THEN 'time' ELSE 'host' END AS how FROM alerts LEFT JOIN logs ON l = line_no LEFT JOIN ft ON t = ft.timestamp LEFT JOIN fh ON alerts.host = fh.host")
def l5(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    n = F.col("line_no")
    alerts = log.where(n % 500 < 3).select(n.cast("string").alias("alert_id"), F.when(n % 3 == 0, n).otherwise(-1).alias("line_no"), F.when(n % 3 == 1, F.col("timestamp")).alias("timestamp"), F.col("host").alias("entity"))
    return samples.locate_alerts(alerts, log)


@query(
    "l6_failure_samples",
    f"""WITH {TOPK}, f AS (SELECT pos AS p, line_no AS l, target, template_id AS t FROM verdict WHERE NOT in_topk ORDER BY pos LIMIT 20),
    n AS (SELECT p, l, target, c.pos, c.template_id, lag(c.template_id) OVER (PARTITION BY p ORDER BY c.pos) AS prev FROM f JOIN coded c ON c.pos BETWEEN p - 50 AND p)
    SELECT p - 50 AS idx, l AS line_no, any_value(target) AS target, string_agg(prev || ' -> ' || template_id, '; ' ORDER BY pos) FILTER (pos > p - 3) AS recent_transitions, round(count(DISTINCT template_id) / count(*), 7) AS sequence_uniqueness FROM n GROUP BY p, l""",
)
def l6(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import sequence as seq

    p = pairs(spark, sf)
    out = samples.failure_samples(seq.infer_top_k(p, trained(p), 3), events_log(spark, sf))
    return out.select("idx", "line_no", "target", F.array_join("recent_transitions", "; ").alias("recent_transitions"), F.round("sequence_uniqueness", 7).alias("sequence_uniqueness"))


@query("l8_spaced_samples", f"WITH {LOGS}, h AS (SELECT line_no, raw, row_number() OVER (ORDER BY timestamp, line_no) - 1 AS pos, count(*) OVER () AS n FROM logs WHERE regexp_matches(raw, '(?i)error|fail|exception|panic|fatal')) SELECT line_no, raw FROM h WHERE pos IN (0, (n - 1) // 4, (n - 1) * 2 // 4, (n - 1) * 3 // 4, n - 1)")
def l8(spark: SparkSession, sf: str) -> DataFrame:
    from ..functions.predicates import is_error

    return samples.spaced_samples(events_log(spark, sf), is_error("raw"))


@query("l8_template_samples", f"WITH {WINDOWED} SELECT template_id, line_no, raw FROM coded WHERE code % 5 = 0 QUALIFY row_number() OVER (PARTITION BY template_id ORDER BY md5(line_no::VARCHAR), line_no) <= 3")
def l8_templates(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    return samples.template_samples(log, win.vocabulary(log).where("index % 5 = 0").select(F.col("template").alias("template_id")))


@query("r1_report_summary", f"WITH RECURSIVE {SCORES}, r AS (SELECT 'baseline' AS method, count(*) AS total, count(*) FILTER (is_anomaly) AS anomalies, avg(is_anomaly::INT) AS rate FROM scores) SELECT method, total, anomalies, round(rate, 7) AS rate, CASE WHEN rate < 0.05 THEN 'normal' WHEN rate < 0.2 THEN 'caution' ELSE 'high' END AS severity FROM r")
def r1(spark: SparkSession, sf: str) -> DataFrame:
    return samples.report_summary(scores(spark, sf)).withColumn("rate", F.round("rate", 7))


@query("r2_score_bins", f"WITH RECURSIVE {SCORES}, e AS (SELECT min(score) AS lo, max(score) AS hi FROM scores) SELECT CAST(greatest(ceil(round((score - lo) / (hi - lo) * 5, 9)) - 1, 0) AS BIGINT) AS bin, count(*) AS n FROM scores, e GROUP BY ALL")
def r2(spark: SparkSession, sf: str) -> DataFrame:
    return samples.score_bins(scores(spark, sf))


@query("r2_hourly_counts", f"WITH {LOGS} SELECT CAST(hour(timestamp) AS INT) AS hour, count(*) AS n FROM logs GROUP BY ALL")
def r2_hours(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"))


@query("r2_top_templates", f"WITH {LOGS} SELECT template_id, count(*) AS n FROM logs GROUP BY ALL ORDER BY n DESC, template_id LIMIT 10")
def r2_top(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).groupBy("template_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template_id").limit(10)


@query("r3_batch_comparison")
def r3(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import batch

    return batch.analyze(sources(spark, sf))


_TWO = WINDOWED + """,
c1 AS (SELECT window_idx, code, cnt AS x FROM counts WHERE code < 18), c2 AS (SELECT window_idx, code, CASE WHEN code = 4 THEN cnt + 1 ELSE cnt END AS y FROM counts WHERE code > 0)"""


@query("g1_matrix_diagnostics", f"WITH {_TWO}, f AS (SELECT coalesce(x, 0) AS x, coalesce(y, 0) AS y FROM c1 FULL JOIN c2 USING (window_idx, code)) SELECT count(*) AS cells, count(*) FILTER (x <> y) AS cells_differing, round(avg((x = y)::INT), 7) AS identical_share, 1 AS codes_only_first, 2 AS codes_only_second FROM f")
def g1(spark: SparkSession, sf: str) -> DataFrame:
    counts = win.window_counts(windowed(spark, sf))
    one, two = counts.where("code < 18"), counts.where("code > 0").withColumn("cnt", F.when(F.col("code") == 4, F.col("cnt") + 1).otherwise(F.col("cnt")))
    return samples.matrix_diagnostics(one, two).withColumn("identical_share", F.round("identical_share", 7))


@query("g1_normalisation_drift", f"WITH {WINDOWED}, a AS (SELECT code, avg(cnt) AS m1, stddev_pop(cnt) AS s1 FROM counts WHERE window_idx < 30 GROUP BY code), b AS (SELECT code, avg(cnt) AS m2, stddev_pop(cnt) AS s2 FROM counts WHERE window_idx >= 30 GROUP BY code) SELECT code, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, abs(m2 - m1) / greatest(abs(m1), 1e-8) > 0.05 OR abs(s2 - s1) / greatest(abs(s1), 1e-8) > 0.05 AS drifted FROM a JOIN b USING (code)")
def g1_drift(spark: SparkSession, sf: str) -> DataFrame:
    counts = win.window_counts(windowed(spark, sf)).withColumnRenamed("cnt", "x")
    out = samples.normalisation_drift(counts.where("window_idx < 30"), counts.where("window_idx >= 30"))
    return out.select("code", F.round("mean_1", 6).alias("mean_1"), F.round("mean_2", 6).alias("mean_2"), "drifted")


@query("g1_region_ratio", f"WITH {ERRORS}, n AS (SELECT max(window_idx) + 1 AS n FROM errs), r AS (SELECT avg(reconstruction_error) FILTER (window_idx < floor(n * 0.8)) AS a, avg(reconstruction_error) FILTER (window_idx >= floor(n * 0.8)) AS b FROM errs, n) SELECT round(a, 6) AS train_mean, round(b, 6) AS validation_mean, round(b / a, 6) AS ratio, b / a > 1.5 AS overfit FROM r")
def g1_region(spark: SparkSession, sf: str) -> DataFrame:
    out = samples.region_ratio(errors(spark, sf))
    return out.withColumns({c: F.round(c, 6) for c in ("train_mean", "validation_mean", "ratio")})


@query("g1_error_histogram", f"WITH {ERRORS}, e AS (SELECT min(reconstruction_error) AS lo, max(reconstruction_error) AS hi FROM errs) SELECT CAST(least(floor((reconstruction_error - lo) / (hi - lo) * 7), 6) AS BIGINT) AS bin, count(*) AS n FROM errs, e GROUP BY ALL")
def g1_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return samples.histogram(errors(spark, sf), "reconstruction_error", 7)


@query("m1_m4_autoencoder")
def m1(spark: SparkSession, sf: str) -> DataFrame:
    """The convolutional network itself: trained with the default parameters, thresholds from the last fifth, all sequences scored."""
    cells = zscores(spark, sf).groupBy("window_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("code", "z"))), lambda x: x["z"]).alias("v"))
    steps = win.window_sequences(written(cells, "cells"), 20)
    model, _ = autoencoder.train(steps)
    errors = written(autoencoder.errors(steps, model), "errors")
    stats = recon.threshold_stats(recon.split(errors)[1])
    return recon.detect(errors, win.window_starts(windowed(spark, sf)), stats)
