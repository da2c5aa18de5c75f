"""Next-template prediction, sessions and alerts over the events log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lstm
from ..operators import sequence as seq
from ..operators import windows as win
from ..sources.adapters import events_log
from .registry import WINDOWED, query

PAIRS = WINDOWED + """,
triples AS (SELECT pos, line_no, timestamp, host, template_id, code AS target, lag(code) OVER (ORDER BY pos) AS c1, lag(code, 2) OVER (ORDER BY pos) AS c2 FROM coded),
pairs AS (SELECT * FROM triples WHERE pos >= 50),
n2 AS (SELECT c2, c1, target AS next, count(*) AS cnt FROM pairs WHERE (pos - 50) % 5 < 4 GROUP BY ALL),
n1 AS (SELECT c1, next, CAST(sum(cnt) AS BIGINT) AS cnt FROM n2 GROUP BY ALL),
n0 AS (SELECT next, CAST(sum(cnt) AS BIGINT) AS cnt FROM n1 GROUP BY ALL),
r2 AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY c2, c1) AS prob, row_number() OVER (PARTITION BY c2, c1 ORDER BY cnt DESC, next) AS rank FROM n2),
r1 AS (SELECT *, cnt / sum(cnt) OVER (PARTITION BY c1) AS prob, row_number() OVER (PARTITION BY c1 ORDER BY cnt DESC, next) AS rank FROM n1),
r0 AS (SELECT *, cnt / sum(cnt) OVER () AS prob, row_number() OVER (ORDER BY cnt DESC, next) AS rank FROM n0)"""
TOPK = PAIRS + """,
ctx AS (SELECT DISTINCT c2, c1 FROM n2),
cand AS (SELECT c2, c1, next, 0 AS level, rank FROM r2 WHERE rank <= 3 UNION ALL SELECT c2, c1, next, 1, rank FROM ctx JOIN r1 USING (c1) WHERE rank <= 6 UNION ALL SELECT c2, c1, next, 2, rank FROM ctx, r0 WHERE rank <= 9),
best AS (SELECT c2, c1, next, min(level * 1000 + rank) AS s FROM cand GROUP BY ALL),
pred AS (SELECT c2, c1, list(next ORDER BY s)[1:3] AS predicted FROM best GROUP BY ALL),
cand1 AS (SELECT c1, next, 0 AS level, rank FROM r1 WHERE rank <= 3 UNION ALL SELECT c1, r0.next, 1, r0.rank FROM (SELECT DISTINCT c1 FROM n1), r0 WHERE r0.rank <= 6),
best1 AS (SELECT c1, next, min(level * 1000 + rank) AS s FROM cand1 GROUP BY ALL),
pred1 AS (SELECT c1, list(next ORDER BY s)[1:3] AS predicted FROM best1 GROUP BY ALL),
pred0 AS (SELECT list(next ORDER BY rank) AS predicted FROM r0 WHERE rank <= 3),
chosen AS (SELECT p.*, coalesce(pred.predicted, pred1.predicted, pred0.predicted) AS predicted FROM pairs p LEFT JOIN pred USING (c2, c1) LEFT JOIN pred1 ON pred1.c1 = p.c1, pred0),
verdict AS (SELECT *, list_contains(predicted, target) AS in_topk FROM chosen)"""
SESSIONS = TOPK + """,
gapped AS (SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY host ORDER BY timestamp, line_no) > 300 * 1000000 THEN 1 ELSE 0 END AS gap FROM verdict),
sess AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY host ORDER BY timestamp, line_no) AS BIGINT) AS session_no FROM gapped),
kofn AS (SELECT *, sum(CASE WHEN in_topk THEN 0 ELSE 1 END) OVER w >= 7 AND row_number() OVER (PARTITION BY host, session_no ORDER BY timestamp, line_no) >= 10 AND NOT in_topk AS triggered
         FROM sess WINDOW w AS (PARTITION BY host, session_no ORDER BY timestamp, line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
LONG = SESSIONS.replace("> 300 * 1000000", "> 86400 * 1000000::BIGINT")


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    return win.contexts(win.encode(log, win.vocabulary(log)), 50, keep=2)


def trained(p: DataFrame) -> DataFrame:
    """The model of four fifths of the pairs, so that some contexts are new to it."""
    return seq.train(p.where("idx % 5 < 4"))


@query("d2_successor_counts", f"WITH {PAIRS} SELECT c1, next, cnt, round(prob, 7) AS prob, rank FROM r1 WHERE rank <= 10")
def d2(spark: SparkSession, sf: str) -> DataFrame:
    return trained(pairs(spark, sf)).where("order = 1 and rank <= 10").select("c1", "next", "cnt", F.round("prob", 7).alias("prob"), F.col("rank").cast("long").alias("rank"))


@query("d3_top_k", f"WITH {TOPK} SELECT pos - 50 AS idx, line_no, target, in_topk, predicted[1] AS predicted_top1, predicted[2] AS predicted_top2, predicted[3] AS predicted_top3 FROM verdict")
def d3(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    out = seq.infer_top_k(p, trained(p), 3)
    return out.select("idx", "line_no", "target", "in_topk", *[F.col("predicted")[i].alias(f"predicted_top{i + 1}") for i in range(3)])


@query(
    "d4_top_p",
    f"""WITH {PAIRS}, c2s AS (SELECT c2, c1, next AS target, coalesce(sum(prob) OVER (PARTITION BY c2, c1 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM r2),
    c1s AS (SELECT c1, next AS target, coalesce(sum(prob) OVER (PARTITION BY c1 ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b1 FROM r1),
    c0s AS (SELECT next AS target, coalesce(sum(prob) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b0 FROM r0)
    SELECT pos - 50 AS idx, line_no, target, coalesce(CASE WHEN (c2, c1) IN (SELECT (c2, c1) FROM n2) THEN b2 WHEN c1 IN (SELECT c1 FROM n1) THEN b1 ELSE b0 END < 0.4, false) AS in_topk
    FROM pairs LEFT JOIN c2s USING (c2, c1, target) LEFT JOIN c1s USING (c1, target) LEFT JOIN c0s USING (target)""",
)
def d4(spark: SparkSession, sf: str) -> DataFrame:
    p = pairs(spark, sf)
    return seq.infer_top_p(p, trained(p), 0.4).select("idx", "line_no", "target", "in_topk")


@query("d5_novelty", f"WITH {WINDOWED} SELECT line_no, host, template_id FROM coded WHERE code % 7 = 3")
def d5(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    trained = win.vocabulary(log).where("index % 7 <> 3").select(F.col("template").alias("__w"))
    return log.join(trained, F.col("template") == F.col("__w"), "left_anti").select("line_no", "host", "template_id")


def sessions(spark: SparkSession, sf: str, timeout: float = 300.0) -> DataFrame:
    p = pairs(spark, sf)
    rows = seq.infer_top_k(p, trained(p), 3).withColumnRenamed("in_topk", "prediction_ok")
    return seq.with_sessions(rows, timeout)


@query("d7_sessions", f"WITH {SESSIONS} SELECT line_no, host, session_no, substr(md5(host || ':' || session_no), 1, 8) AS session_id FROM sess")
def d7(spark: SparkSession, sf: str) -> DataFrame:
    return sessions(spark, sf).select("line_no", "host", "session_no", "session_id")


@query("d6_k_of_n", f"WITH {LONG} SELECT line_no, host, session_no, in_topk AS prediction_ok, triggered AS k_of_n_triggered FROM kofn")
def d6(spark: SparkSession, sf: str) -> DataFrame:
    return seq.k_of_n(sessions(spark, sf, 86400.0)).select("line_no", "host", "session_no", "prediction_ok", "k_of_n_triggered")


_COOL = """cand_alerts AS (SELECT line_no, host, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY host ORDER BY timestamp, line_no) AS r FROM kofn WHERE triggered),
cool AS (SELECT host, r, line_no, t AS last, true AS alerted FROM cand_alerts WHERE r = 1
  UNION ALL SELECT c.host, c.r, c.line_no, CASE WHEN c.t - f.last >= 3600 * 1000000::BIGINT THEN c.t ELSE f.last END, c.t - f.last >= 3600 * 1000000::BIGINT
  FROM cool f JOIN cand_alerts c ON c.host = f.host AND c.r = f.r + 1)"""


@query("d8_cooldown", f"WITH RECURSIVE {LONG}, {_COOL} SELECT line_no, host FROM cool WHERE alerted")
def d8(spark: SparkSession, sf: str) -> DataFrame:
    rows = seq.k_of_n(sessions(spark, sf, 86400.0)).where("k_of_n_triggered").withColumn("signature", F.concat("host", F.lit(":SEQ_FAIL")))
    return seq.cooled(rows.select("line_no", "timestamp", "host", "signature"), F.lit(3600.0)).select("line_no", "host")


def _enhanced(spark: SparkSession, sf: str, top_p: float | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    log = events_log(spark, sf)
    words = win.vocabulary(log).where("index % 7 <> 3")
    p = win.contexts(win.encode(log, words), 50, keep=2)
    config = seq.AlertConfig(top_p=top_p, session_timeout=86400.0, cooldown_sequence=3600.0, cooldown_novelty=3600.0)
    return seq.infer_enhanced(log, words, trained(p), config)


_NOVEL = """nov AS (SELECT template_id, host || template_id AS sig, line_no, epoch_us(timestamp) AS t, timestamp, row_number() OVER (PARTITION BY host, template_id ORDER BY timestamp, line_no) AS r FROM coded WHERE code % 7 = 3),
cool AS (SELECT sig, r, t AS last, true AS alerted FROM nov WHERE r = 1
  UNION ALL SELECT n.sig, n.r, CASE WHEN n.t - f.last >= 3600 * 1000000::BIGINT THEN n.t ELSE f.last END, n.t - f.last >= 3600 * 1000000::BIGINT FROM cool f JOIN nov n ON n.sig = f.sig AND n.r = f.r + 1)"""


@query("d9_novelty_aggregation", f'WITH RECURSIVE {WINDOWED}, {_NOVEL} SELECT template_id, count(*) AS "count", min(timestamp) AS "first", max(timestamp) AS "last" FROM cool JOIN nov USING (sig, r) WHERE alerted GROUP BY template_id')
def d9(spark: SparkSession, sf: str) -> DataFrame:
    return seq.novelty_aggregation(_enhanced(spark, sf)[1])


_KNOWN = TOPK.replace("triples AS (", "known AS (SELECT * REPLACE (row_number() OVER (ORDER BY pos) - 1 AS pos) FROM coded WHERE code % 7 <> 3),\ntriples AS (").replace("AS c2 FROM coded)", "AS c2 FROM known)")
_BEFORE = "coalesce(sum(prob) OVER (PARTITION BY {} ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_TOP_P = _KNOWN.replace("verdict AS (SELECT *, list_contains(predicted, target) AS in_topk FROM chosen)", f"""c2s AS (SELECT c2, c1, next AS target, {_BEFORE.format("c2, c1")} AS b2 FROM r2),
c1s AS (SELECT c1, next AS target, {_BEFORE.format("c1")} AS b1 FROM r1),
c0s AS (SELECT next AS target, {_BEFORE.format("1")} AS b0 FROM r0),
verdict AS (SELECT pairs.*, coalesce(CASE WHEN (c2, c1) IN (SELECT (c2, c1) FROM n2) THEN b2 WHEN c1 IN (SELECT c1 FROM n1) THEN b1 ELSE b0 END < 0.9, false) AS in_topk
            FROM pairs LEFT JOIN c2s USING (c2, c1, target) LEFT JOIN c1s USING (c1, target) LEFT JOIN c0s USING (target))""")
_DETAIL = """,
judged AS (SELECT line_no, timestamp, host, target, NULL::VARCHAR AS template, false AS is_novel, in_topk AS prediction_ok FROM verdict
  UNION ALL SELECT line_no, timestamp, host, NULL, template_id, true, true FROM coded WHERE code % 7 = 3),
parted AS (SELECT *, CASE WHEN epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY host ORDER BY timestamp, line_no) > 86400 * 1000000::BIGINT THEN 1 ELSE 0 END AS gap FROM judged),
seated AS (SELECT *, CAST(sum(gap) OVER (PARTITION BY host ORDER BY timestamp, line_no) AS BIGINT) AS session_no FROM parted),
detail AS (SELECT * EXCLUDE (gap), substr(md5(host || ':' || session_no), 1, 8) AS session_id, list(NOT prediction_ok) OVER w AS recent,
    sum(CASE WHEN prediction_ok THEN 0 ELSE 1 END) OVER w >= 7 AND row_number() OVER (PARTITION BY host, session_no ORDER BY timestamp, line_no) >= 10 AND NOT prediction_ok AS k_of_n_triggered
  FROM seated WINDOW w AS (PARTITION BY host, session_no ORDER BY timestamp, line_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))"""
_ALERTS = _KNOWN + _DETAIL + """,
proposed AS (SELECT *, host || ':SEQ_FAIL' AS signature, 'SEQ_FAIL' AS alert_type, NULL::VARCHAR AS template_id FROM detail WHERE k_of_n_triggered
  UNION ALL SELECT *, host || ':NOVELTY:' || template, 'NOVELTY', template FROM detail WHERE is_novel),
queued AS (SELECT *, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY signature ORDER BY timestamp, line_no) AS r FROM proposed),
kept AS (SELECT signature, r, t AS last, true AS alerted FROM queued WHERE r = 1
  UNION ALL SELECT q.signature, q.r, CASE WHEN q.t - k.last >= 3600 * 1000000::BIGINT THEN q.t ELSE k.last END, q.t - k.last >= 3600 * 1000000::BIGINT FROM kept k JOIN queued q ON q.signature = k.signature AND q.r = k.r + 1),
alerts AS (SELECT queued.*, row_number() OVER (PARTITION BY signature ORDER BY r) = 1 AS first_occurrence FROM queued JOIN kept USING (signature, r) WHERE alerted)"""
_SHOWN = "line_no, timestamp, host, target, template, is_novel, prediction_ok, session_no, session_id, k_of_n_triggered"


@query("d10_enhanced_detail", f"WITH {_KNOWN}{_DETAIL} SELECT {_SHOWN} FROM detail")
def d10_detail(spark: SparkSession, sf: str) -> DataFrame:
    return _enhanced(spark, sf)[0].drop("recent_failures")


@query("d10_enhanced_detail_top_p", f"WITH {_TOP_P}{_DETAIL} SELECT {_SHOWN} FROM detail")
def d10_detail_top_p(spark: SparkSession, sf: str) -> DataFrame:
    return _enhanced(spark, sf, 0.9)[0].drop("recent_failures")


@query(
    "d10_enhanced_alerts",
    f"""WITH RECURSIVE {_ALERTS} SELECT md5(signature || ':' || line_no) AS alert_id, timestamp, line_no, host AS entity, alert_type, template_id, session_id,
    CASE WHEN alert_type = 'SEQ_FAIL' THEN CAST(len(list_filter(recent, lambda x: x)) AS INT) END AS k_of_n_failures, target AS target_template_idx, is_novel,
    array_to_string(list_transform(recent, lambda x: CASE WHEN x THEN '1' ELSE '0' END), '') AS recent_failures, first_occurrence FROM alerts""",
)
def d10_alerts(spark: SparkSession, sf: str) -> DataFrame:
    """The alerts, their details as columns."""
    found = _enhanced(spark, sf)[1].select("*", "details.*").drop("details")
    return found.withColumn("recent_failures", F.array_join(F.transform("recent_failures", lambda x: F.when(x, "1").otherwise("0")), ""))


@query(
    "d10_enhanced_summary",
    f"""WITH RECURSIVE {_ALERTS}, n AS (SELECT count(*) FILTER (alert_type = 'SEQ_FAIL') AS seq_fail_alerts, count(*) FILTER (alert_type = 'NOVELTY') AS novelty_alerts FROM alerts)
    SELECT count(*) AS total_sequences, count(*) FILTER (NOT prediction_ok) AS failures, count(*) FILTER (is_novel) AS novel, count(*) FILTER (k_of_n_triggered) AS k_of_n,
    count(DISTINCT session_id) AS sessions, any_value(seq_fail_alerts) AS seq_fail_alerts, any_value(novelty_alerts) AS novelty_alerts FROM detail, n""",
)
def d10_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The totals, with the map of alerts by type as columns."""
    number = lambda kind: F.coalesce(F.try_element_at("alerts_by_type", F.lit(kind)), F.lit(0)).cast("long")
    return _enhanced(spark, sf)[2].select("*", number("SEQ_FAIL").alias("seq_fail_alerts"), number("NOVELTY").alias("novelty_alerts")).drop("alerts_by_type")


@query("d1_lstm_top_k")
def d1(spark: SparkSession, sf: str) -> DataFrame:
    """The recurrent network itself, trained with the default parameters."""
    log = events_log(spark, sf)
    words = win.vocabulary(log)
    p = win.contexts(win.encode(log, words), 50)
    model = lstm.train(p, words.count())
    return lstm.infer_top_k(p, model, 3)
