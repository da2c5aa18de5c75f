"""Windows and the baseline detector over the events log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import baseline as base
from ..operators import windows as win
from ..sources.adapters import events_log
from .registry import EWM, FEATURES, LOGS, POS, SCORES, WINDOWED, query


def _round(df: DataFrame, *columns: str, digits: int = 7) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def windowed(spark: SparkSession, sf: str) -> DataFrame:
    return win.in_windows(win.template_codes(win.with_position(events_log(spark, sf))))


@query("line_positions", f"WITH {POS} SELECT line_no, pos FROM pos")
def line_positions(spark: SparkSession, sf: str) -> DataFrame:
    return win.with_position(events_log(spark, sf)).select("line_no", "pos")


@query("w1_sliding_windows", f"WITH {WINDOWED} SELECT window_idx, count(*) AS n_lines, min(pos) AS first_pos, max(pos) AS last_pos FROM win GROUP BY window_idx")
def w1(spark: SparkSession, sf: str) -> DataFrame:
    return win.in_windows(win.with_position(events_log(spark, sf))).groupBy("window_idx").agg(F.count("*").alias("n_lines"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query("w2_window_counts", f"WITH {WINDOWED} SELECT window_idx, code, cnt FROM counts")
def w2(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_counts(windowed(spark, sf))


@query("w3_window_starts", f"WITH {WINDOWED} SELECT window_idx, start_index FROM starts")
def w3(spark: SparkSession, sf: str) -> DataFrame:
    return win.window_starts(windowed(spark, sf))


_WIDE = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (code = {c}), 0) AS BIGINT) AS t{c}" for c in range(20))


@query("w4_window_count_matrix", f"WITH {WINDOWED} SELECT window_idx, any_value(start_index) AS start_index, {_WIDE} FROM counts JOIN starts USING (window_idx) GROUP BY window_idx")
def w4(spark: SparkSession, sf: str) -> DataFrame:
    rows = windowed(spark, sf)
    return win.count_matrix(win.window_counts(rows), list(range(20)), win.window_starts(rows))


_EVEN = ", ".join(f"CAST(coalesce(sum(cnt) FILTER (code = {c}), 0) AS BIGINT) AS t{c}" for c in range(0, 24, 2))


@query("w5_trained_mapping_matrix", f"WITH {WINDOWED} SELECT s.window_idx, any_value(start_index) AS start_index, {_EVEN} FROM starts s LEFT JOIN counts USING (window_idx) GROUP BY s.window_idx")
def w5(spark: SparkSession, sf: str) -> DataFrame:
    rows = windowed(spark, sf)
    return win.count_matrix(win.window_counts(rows), list(range(0, 24, 2)), win.window_starts(rows))


@query("w6_vocabulary", f"WITH {LOGS} SELECT template_id AS template, row_number() OVER (ORDER BY template_id) - 1 AS index FROM (SELECT DISTINCT template_id FROM logs)")
def w6(spark: SparkSession, sf: str) -> DataFrame:
    return win.vocabulary(events_log(spark, sf))


@query("w7_sequence_encode", f"WITH {WINDOWED} SELECT line_no, timestamp, host, code AS template_index FROM coded")
def w7(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    return win.encode(log, win.vocabulary(log))


@query(
    "w8_context_target_pairs",
    f"""WITH {WINDOWED}, c AS (SELECT pos, line_no, code, list(code) OVER (ORDER BY pos ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS context FROM coded)
    SELECT pos - 50 AS idx, line_no, code AS target, array_to_string(context, ',') AS context FROM c WHERE pos >= 50""",
)
def w8(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    pairs = win.contexts(win.encode(log, win.vocabulary(log)), 50)
    return pairs.select("idx", "line_no", "target", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(window_idx, v): counts of the 20 codes of each window."""
    matrix = w4(spark, sf)
    return matrix.select("window_idx", F.array(*[F.col(f"t{c}").cast("double") for c in range(20)]).alias("v"))


@query(
    "w9_window_sequences",
    f"""WITH {WINDOWED}, s AS (SELECT window_idx, CAST(sum(cnt * (code + 1)) AS BIGINT) AS s FROM counts GROUP BY window_idx),
    q AS (SELECT window_idx, list(s) OVER (ORDER BY window_idx ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS l FROM s)
    SELECT window_idx, array_to_string(l, ',') AS steps FROM q WHERE len(l) = 20""",
)
def w9(spark: SparkSession, sf: str) -> DataFrame:
    steps = win.window_sequences(vectors(spark, sf), 20)
    weigh = lambda v: F.aggregate(F.zip_with(v, F.sequence(F.lit(1), F.lit(20)), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return steps.select("window_idx", F.array_join(F.transform("steps", lambda v: weigh(v).cast("long").cast("string")), ",").alias("steps"))


@query("w10_width_adaptation", f"WITH {WINDOWED}, d AS (SELECT window_idx, CAST(sum(cnt) FILTER (code < 12) AS BIGINT) AS kept FROM counts GROUP BY window_idx) SELECT window_idx, kept, 12 AS cut_width, 24 AS padded_width FROM d")
def w10(spark: SparkSession, sf: str) -> DataFrame:
    cut, padded = win.adapt_width(F.col("v"), 12), win.adapt_width(F.col("v"), 24)
    total = F.aggregate(cut, F.lit(0.0), lambda s, x: s + x).cast("long")
    return vectors(spark, sf).select("window_idx", total.alias("kept"), F.size(cut).alias("cut_width"), F.size(padded).alias("padded_width"))


_DENSE = """grid AS (SELECT s.window_idx, c.code, coalesce(n.cnt, 0)::DOUBLE AS x FROM starts s CROSS JOIN codes c LEFT JOIN counts n ON n.window_idx = s.window_idx AND n.code = c.code),
zs AS (SELECT window_idx, code, (x - avg(x) OVER (PARTITION BY code)) / (stddev_pop(x) OVER (PARTITION BY code) + 1e-8) AS z FROM grid)"""


def zscores(spark: SparkSession, sf: str) -> DataFrame:
    """(window_idx, code, z): counts standardised per code over this data set's windows."""
    cells = vectors(spark, sf).select("window_idx", F.posexplode("v").alias("code", "x"))
    by = W.partitionBy("code")
    return cells.select("window_idx", F.col("code").cast("long").alias("code"), ((F.col("x") - F.avg("x").over(by)) / (F.stddev_pop("x").over(by) + 1e-8)).alias("z"))


@query("w11_column_zscore", f"WITH {WINDOWED}, {_DENSE} SELECT window_idx, code, round(z, 6) + 0.0 AS z FROM zs")
def w11(spark: SparkSession, sf: str) -> DataFrame:
    return _round(zscores(spark, sf), "z", digits=6).withColumn("z", F.col("z") + 0.0)


@query("w12_context_lines", f"WITH {LOGS}, a AS (SELECT line_no AS anchor FROM logs WHERE line_no % 997 = 5) SELECT anchor, line_no, raw, line_no = anchor AS is_anchor FROM logs JOIN a ON line_no BETWEEN anchor - 3 AND anchor + 3")
def w12(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    anchors = log.where("line_no % 997 = 5").select(F.col("line_no").alias("anchor"))
    return win.context_lines(log, anchors).select("anchor", "line_no", "raw", "is_anchor")


@query("w13_time_gaps", f"WITH {LOGS} SELECT line_no, round(epoch(timestamp) - epoch(lag(timestamp) OVER (ORDER BY timestamp, line_no)), 4) AS gap_s FROM logs WHERE timestamp IS NOT NULL")
def w13(spark: SparkSession, sf: str) -> DataFrame:
    return _round(win.gaps(events_log(spark, sf)).select("line_no", "gap_s"), "gap_s", digits=4)


@query("w14_template_transitions", f"WITH {POS}, t AS (SELECT template_id AS f, lead(template_id) OVER (ORDER BY pos) AS t FROM pos) SELECT f AS from_template, t AS to_template, count(*) AS n FROM t WHERE t IS NOT NULL GROUP BY ALL")
def w14(spark: SparkSession, sf: str) -> DataFrame:
    return win.transitions(events_log(spark, sf)).groupBy(F.col("from").alias("from_template"), F.col("to").alias("to_template")).agg(F.count("*").alias("n"))


@query("w15_unseen_templates", f"WITH {WINDOWED}, f AS (SELECT window_idx, code, min(window_idx) OVER (PARTITION BY code) AS f FROM counts) SELECT window_idx, count(*) AS n_codes, CAST(sum(CASE WHEN window_idx = f THEN 1 ELSE 0 END) AS BIGINT) AS n_new FROM f GROUP BY window_idx")
def w15(spark: SparkSession, sf: str) -> DataFrame:
    return win.first_seen(win.window_counts(windowed(spark, sf))).groupBy("window_idx").agg(F.count("*").alias("n_codes"), F.count_if("is_new").alias("n_new"))


@query("b2_ewm_fold", f"WITH RECURSIVE {EWM} SELECT window_idx, code, cnt, round(mean, 7) AS mean, round(variance, 6) AS variance, round(z, 6) AS z FROM ewm")
def b2(spark: SparkSession, sf: str) -> DataFrame:
    scored = base.ewm_scores(win.window_counts(windowed(spark, sf)), 0.3)
    return _round(_round(scored, "mean"), "variance", "z", digits=6)


@query("b5_window_features", f"WITH RECURSIVE {FEATURES} SELECT window_idx, window_start_line, round(freq_z, 6) AS freq_z, round(unseen_rate, 7) AS unseen_rate FROM features")
def b5(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_round(base.window_features(events_log(spark, sf)), "freq_z", digits=6), "unseen_rate")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    return base.detect(events_log(spark, sf))


_SHOWN = "window_start_line, round(unseen_rate, 7) AS unseen_rate, round(freq_z, 6) AS freq_z, round(freq_norm, 6) AS freq_norm, round(unseen_norm, 7) AS unseen_norm, round(score, 6) AS score, is_anomaly"


@query("baseline_scores", f"WITH RECURSIVE {SCORES} SELECT {_SHOWN} FROM scores")
def baseline_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _round(_round(scores(spark, sf), "unseen_rate", "unseen_norm"), "freq_z", "freq_norm", "score", digits=6)


_STATS = "count(*) AS total_windows, count(*) FILTER (NOT is_anomaly) AS normal_windows, round(avg(is_anomaly::INT), 7) AS anomaly_rate, " + ", ".join(
    f"round(avg({c}) FILTER (NOT is_anomaly), 6) AS mean_{c}, round(stddev_samp({c}) FILTER (NOT is_anomaly), 6) AS std_{c}" for c in ("unseen_rate", "freq_z", "score")
)


@query("b10_normal_stats", f"WITH RECURSIVE {SCORES} SELECT {_STATS} FROM scores")
def b10(spark: SparkSession, sf: str) -> DataFrame:
    stats = base.normal_stats(scores(spark, sf))
    return _round(_round(stats, "anomaly_rate"), *[c for c in stats.columns if c[:3] in ("mea", "std")], digits=6)


@query(
    "b11_enhanced_scores",
    f"""WITH RECURSIVE {SCORES}, n AS (SELECT avg(unseen_rate) AS mu, stddev_samp(unseen_rate) AS su, avg(freq_z) AS mf, stddev_samp(freq_z) AS sf FROM scores WHERE NOT is_anomaly),
    z AS (SELECT scores.*, (unseen_rate - mu) / (su + 1e-8) AS zu, (freq_z - mf) / (sf + 1e-8) AS zf FROM scores, n),
    s AS (SELECT *, round(sqrt(zu ** 2 + zf ** 2), 9) AS a FROM z)
    SELECT window_start_line, round(zu, 5) + 0.0 AS unseen_rate_zscore, round(zf, 5) + 0.0 AS freq_zscore, round(a, 5) AS anomaly_score, a > (SELECT quantile_cont(a, 0.95) FROM s) AS is_strong_anomaly FROM s""",
)
def b11(spark: SparkSession, sf: str) -> DataFrame:
    found = scores(spark, sf)
    out = base.enhance(found, base.normal_stats(found)).select("window_start_line", "unseen_rate_zscore", "freq_zscore", "anomaly_score", "is_strong_anomaly")
    out = _round(out, "unseen_rate_zscore", "freq_zscore", "anomaly_score", digits=5)
    return out.withColumns({c: F.col(c) + 0.0 for c in ("unseen_rate_zscore", "freq_zscore")})


_OLD = SCORES.replace("FROM events)", "FROM events WHERE event_id % 5 < 4)")
_BOTH = SCORES.replace("FROM events)", "FROM (SELECT * FROM events WHERE event_id % 5 < 4 UNION ALL SELECT * REPLACE (event_id + (SELECT max(event_id) + 1 FROM events WHERE event_id % 5 < 4) AS event_id) FROM events WHERE event_id % 5 = 4))")


@query(
    "b12_incremental_baseline",
    f"""SELECT a.*, n AS previous_normal_windows, normal_windows - n AS added_normal_windows, round(normal_windows / greatest(n, 1), 7) AS improvement_ratio
    FROM (WITH RECURSIVE {_BOTH} SELECT {_STATS} FROM scores) a, (WITH RECURSIVE {_OLD} SELECT count(*) FILTER (NOT is_anomaly) AS n FROM scores) b""",
)
def b12(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    out = base.incremental(log.where("line_no % 5 < 4"), log.where("line_no % 5 = 4"))
    return _round(_round(out, "anomaly_rate", "improvement_ratio"), *[c for c in out.columns if c[:3] in ("mea", "std")], digits=6)
