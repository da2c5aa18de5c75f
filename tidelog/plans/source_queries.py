"""Temporal and comparative analysis of the events log, its hosts as sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import comparative as comp
from ..operators import temporal
from ..sources.adapters import events_log
from .registry import LOGS, query


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).withColumn("source", F.col("host"))


DAYS = """period AS (SELECT min(timestamp) AS "start", max(timestamp) AS "end", CAST(floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) + 1 AS BIGINT) AS total_days FROM logs)"""


@query("p1_baseline_period", f'WITH {LOGS}, {DAYS} SELECT "start", "end", total_days FROM period')
def p1(spark: SparkSession, sf: str) -> DataFrame:
    return temporal.period(events_log(spark, sf))


def _ranked(unit: str, top: int) -> str:
    return f"""tc AS (SELECT {unit} AS u, template_id, count(*) AS c, min(line_no) AS first FROM logs WHERE timestamp IS NOT NULL GROUP BY ALL),
    tr AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY c DESC, first) AS r, c / sum(c) OVER (PARTITION BY u) AS share FROM tc),
    prof AS (SELECT u, CAST(sum(c) AS BIGINT) AS n, count(*) AS unique_templates, list(template_id ORDER BY r) FILTER (r <= {top}) AS tops, max(share) AS top_share FROM tr GROUP BY u)"""


@query("p2_hourly_profile", f"WITH {LOGS}, {DAYS}, {_ranked('hour(timestamp)', 5)} SELECT CAST(u AS INT) AS hour, round(n / total_days, 7) AS volume_mean, round(n * 0.1::DOUBLE, 7) AS volume_std, array_to_string(tops, ',') AS top_templates, unique_templates, round(top_share, 7) AS top_share FROM prof, period")
def p2(spark: SparkSession, sf: str) -> DataFrame:
    out = temporal.hourly_profile(events_log(spark, sf))
    return out.select("hour", F.round("volume_mean", 7).alias("volume_mean"), F.round("volume_std", 7).alias("volume_std"), F.array_join("top_templates", ",").alias("top_templates"), "unique_templates", F.round(F.array_max(F.map_values("template_distribution")), 7).alias("top_share"))


@query("p3_weekday_profile", f"WITH {LOGS}, {DAYS}, {_ranked('isodow(timestamp) - 1', 10)} SELECT CAST(u AS INT) AS weekday, round(n / (total_days // 7 + 1), 7) AS volume_mean, array_to_string(tops, ',') AS top_templates, unique_templates FROM prof, period")
def p3(spark: SparkSession, sf: str) -> DataFrame:
    out = temporal.weekday_profile(events_log(spark, sf))
    return out.select("weekday", F.round("volume_mean", 7).alias("volume_mean"), F.array_join("top_templates", ",").alias("top_templates"), "unique_templates")


#: a profile of the first hours of each day of host h0 .. h3, so that all four kinds of anomaly occur
_SPLIT = f"""WITH {LOGS}, base AS (SELECT * FROM logs WHERE hour(timestamp) < 20 AND host < 'h4'), target AS (SELECT * FROM logs WHERE host >= 'h4' AND (line_no % 11 < 4 OR hour(timestamp) > 10)),
days AS (SELECT floor((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 86400000000) + 1 AS d FROM base),
tc AS (SELECT hour(timestamp) AS h, template_id, count(*) AS c, min(line_no) AS first FROM base GROUP BY ALL),
tr AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY c DESC, first) AS r FROM tc),
prof AS (SELECT h, sum(c) / any_value(d) AS e, list(template_id ORDER BY r) FILTER (r <= 5) AS tops FROM tr, days GROUP BY h),
seen AS (SELECT hour(timestamp) AS h, count(*) AS n, list(DISTINCT template_id) AS actual FROM target GROUP BY ALL),
j AS (SELECT seen.*, e, tops, abs(n - e) / greatest(e, 1) AS dev, list_sort(list_filter(actual, lambda x: NOT list_contains(tops, x))) AS fresh, list_sort(list_filter(tops, lambda x: NOT list_contains(actual, x))) AS gone FROM seen LEFT JOIN prof USING (h)),
kinds AS (
  SELECT 'temporal_unseen_hour' AS type, h, 'high' AS severity, n, e, NULL::DOUBLE AS dev, NULL::VARCHAR AS templates FROM j WHERE e IS NULL
  UNION ALL SELECT 'temporal_volume_anomaly', h, CASE WHEN dev > 1 THEN 'high' ELSE 'medium' END, n, e, dev, NULL FROM j WHERE dev > 0.5
  UNION ALL SELECT 'temporal_new_templates', h, 'medium', n, e, NULL, array_to_string(fresh, ',') FROM j WHERE len(fresh) > 0.2 * len(tops) AND len(fresh) > 0
  UNION ALL SELECT 'temporal_missing_templates', h, 'medium', n, e, NULL, array_to_string(gone, ',') FROM j WHERE len(gone) > 0)
"""


def _temporal(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    hour = F.hour("timestamp")
    base, target = log.where((hour < 20) & (F.col("host") < "h4")), log.where((F.col("host") >= "h4") & ((F.col("line_no") % 11 < 4) | (hour > 10)))
    out = temporal.analyze(target, base)
    return out.select("type", "hour", "severity", "actual_volume", F.round("expected_volume", 6).alias("expected_volume"), F.round("deviation", 6).alias("deviation"), F.array_join("templates", ",").alias("templates"))


def _temporal_query(name: str, kind: str) -> None:
    @query(name, f"{_SPLIT} SELECT type, CAST(h AS INT) AS hour, severity, n AS actual_volume, round(e, 6) AS expected_volume, round(dev, 6) AS deviation, templates FROM kinds WHERE type = '{kind}'")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return _temporal(spark, sf).where(F.col("type") == kind)


for _i, _kind in enumerate(("unseen_hour", "volume_anomaly", "new_templates", "missing_templates"), 4):
    _temporal_query(f"p{_i}_{_kind}", f"temporal_{_kind}")


SRC = LOGS + """,
tc AS (SELECT host AS source, template_id AS key, count(*) AS n, min(line_no) AS first FROM logs GROUP BY ALL),
sh AS (SELECT source, key, n, first, n / sum(n) OVER (PARTITION BY source) AS share FROM tc)"""
_ERR = "avg(regexp_matches(raw, '(?i)error|fail|exception|panic|fatal')::INT)"
_PROFILE = SRC + f""",
prof AS (SELECT host AS source, count(*) AS total_logs, count(DISTINCT template_id) AS unique_templates, count(DISTINCT process) AS unique_processes, {_ERR} AS error_rate, avg(regexp_matches(raw, '(?i)warn')::INT) AS warning_rate,
         (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS duration_hours FROM logs GROUP BY host),
ent AS (SELECT source, -sum(share * log2(share)) AS template_entropy, count(*) FILTER (n = 1) AS rare_templates_count FROM sh GROUP BY source)"""


@query("c1_source_profiles", f"WITH {_PROFILE} SELECT source, total_logs, unique_templates, unique_processes, round(error_rate, 7) AS error_rate, round(warning_rate, 7) AS warning_rate, round(template_entropy, 6) AS template_entropy, rare_templates_count, round(duration_hours, 5) AS duration_hours, round(total_logs / greatest(duration_hours, 1), 5) AS logs_per_hour FROM prof JOIN ent USING (source)")
def c1(spark: SparkSession, sf: str) -> DataFrame:
    p = comp.profiles(sources(spark, sf))
    r = lambda c, d: F.round(c, d).alias(c)
    return p.select("source", "total_logs", "unique_templates", "unique_processes", r("error_rate", 7), r("warning_rate", 7), r("template_entropy", 6), "rare_templates_count", r("duration_hours", 5), r("logs_per_hour", 5))


def _distribution_query(column: str) -> None:
    @query(f"c2_{column.removesuffix('_id')}_distribution", f"WITH {LOGS}, c AS (SELECT process AS source, {column} AS key, count(*) AS n FROM logs GROUP BY ALL) SELECT source, key, n, round(n / sum(n) OVER (PARTITION BY source), 7) AS share FROM c")
    def run(spark: SparkSession, sf: str) -> DataFrame:
        log = events_log(spark, sf).withColumn("source", F.col("process"))
        return comp.distribution(log, column).withColumn("share", F.round("share", 7))


for _column in ("template_id", "host", "process"):
    _distribution_query(_column)


@query("c3_entropy", f"WITH {_PROFILE} SELECT source, round(template_entropy, 6) AS entropy FROM ent")
def c3(spark: SparkSession, sf: str) -> DataFrame:
    return comp.entropy(comp.distribution(sources(spark, sf), "template_id")).withColumn("entropy", F.round("entropy", 6))


@query("c4_rare_templates", f"WITH {LOGS}, t AS (SELECT host AS source, raw, count(*) AS n, min(line_no) AS first FROM logs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY first) AS r FROM t WHERE n = 1) SELECT source, count(*) AS rare_templates_count, string_agg(raw, ',' ORDER BY r) FILTER (r <= 10) AS rare_templates FROM r GROUP BY source")
def c4(spark: SparkSession, sf: str) -> DataFrame:
    log = sources(spark, sf).withColumn("template_id", F.col("raw"))
    return comp.rare_templates(log).where("rare_templates_count > 0").withColumn("rare_templates", F.array_join("rare_templates", ","))


_PAIR = SRC + """,
p AS (SELECT key, share FROM sh WHERE source = 'h0' AND key NOT LIKE 'click%'), q AS (SELECT key, sum(share) / (SELECT count(DISTINCT source) FROM sh WHERE source <> 'h0') AS share FROM sh WHERE source <> 'h0' AND key NOT LIKE 'view%' GROUP BY key),
b AS (SELECT coalesce(p.key, q.key) AS key, p.share IS NOT NULL AS hp, q.share IS NOT NULL AS hq, coalesce(p.share, 0) + 1e-10 AS p, coalesce(q.share, 0) + 1e-10 AS q FROM p FULL JOIN q ON p.key = q.key),
n AS (SELECT key, hp, hq, p / (SELECT sum(p) FROM b) AS p, q / (SELECT sum(q) FROM b) AS q FROM b)"""


def _two(spark: SparkSession, sf: str) -> DataFrame:
    shares = comp.distribution(sources(spark, sf), "template_id")
    average = comp.average_distribution(shares.where("source <> 'h0'"))
    return comp.compare(shares.where("source = 'h0' and key not like 'click%'"), average.where("key not like 'view%'"))


@query("c6_kl_divergence", f"WITH {_PAIR} SELECT round(sum(p * ln(p / q)), 6) AS kl_divergence FROM n")
def c6(spark: SparkSession, sf: str) -> DataFrame:
    return _two(spark, sf).select(F.round("kl_divergence", 6).alias("kl_divergence"))


@query(
    "c7_set_comparison",
    f"WITH {_PAIR} SELECT count(*) FILTER (hp AND hq) AS common_templates, count(*) FILTER (hp AND NOT hq) AS target_only_templates, count(*) FILTER (hq AND NOT hp) AS baseline_only_templates, round(count(*) FILTER (hp AND hq) / count(*), 7) AS jaccard_similarity, array_to_string(list(key ORDER BY key) FILTER (hp AND NOT hq), ',') AS unique_in_target, array_to_string(list(key ORDER BY key) FILTER (hq AND NOT hp), ',') AS missing_from_target, array_to_string(list(key ORDER BY p DESC, key) FILTER (hp)[1:5], ',') AS target_top_templates FROM n",
)
def c7(spark: SparkSession, sf: str) -> DataFrame:
    out = _two(spark, sf)
    lists = [F.array_join(c, ",").alias(c) for c in ("unique_in_target", "missing_from_target", "target_top_templates")]
    return out.select("common_templates", "target_only_templates", "baseline_only_templates", F.round("jaccard_similarity", 7).alias("jaccard_similarity"), *lists)


@query("c9_average_distribution", f"WITH {SRC} SELECT key, round(sum(share) / (SELECT count(DISTINCT source) FROM sh), 7) AS share FROM sh GROUP BY key")
def c9(spark: SparkSession, sf: str) -> DataFrame:
    return comp.average_distribution(comp.distribution(sources(spark, sf), "template_id")).withColumn("share", F.round("share", 7))


_METRICS = " UNION ALL ".join(f"SELECT source, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM prof JOIN ent USING (source)" for m in comp.METRICS)


@query(
    "c8_metric_tests",
    f"""WITH {_PROFILE.replace("host AS source", "process AS source").replace("GROUP BY host", "GROUP BY process")}, m AS ({_METRICS}), s AS (SELECT metric, avg(value) AS mu, stddev_pop(value) AS sd FROM m WHERE source <> 'error' GROUP BY metric),
    z AS (SELECT metric, value, mu, sd, abs(value - mu) / greatest(sd, 1e-6) AS z FROM m JOIN s USING (metric) WHERE source = 'error')
    SELECT 'metric_anomaly_' || metric AS type, CASE WHEN z > 3 THEN 'high' ELSE 'medium' END AS severity, round(value, 6) AS target_value, round(mu, 6) AS baseline_mean, round(sd, 6) AS baseline_std, round(z, 4) AS z_score FROM z WHERE z > 2""",
)
def c8(spark: SparkSession, sf: str) -> DataFrame:
    p = comp.profiles(events_log(spark, sf).withColumn("source", F.col("process")))
    out = comp.metric_anomalies(p.where("source = 'error'"), p.where("source <> 'error'"))
    return out.select("type", "severity", *[F.round(c, 6).alias(c) for c in ("target_value", "baseline_mean", "baseline_std")], F.round("z_score", 4).alias("z_score"))


@query("c10_c11_distribution_anomalies", f"""WITH {LOGS}, t AS (SELECT process AS source, template_id AS key, count(*) AS n FROM logs GROUP BY ALL), sh AS (SELECT source, key, n / sum(n) OVER (PARTITION BY source) AS share FROM t),
    p AS (SELECT key, share FROM sh WHERE source = 'error'), q AS (SELECT key, sum(share) / (SELECT count(DISTINCT source) FROM sh WHERE source <> 'error') AS share FROM sh WHERE source <> 'error' GROUP BY key),
    b AS (SELECT p.share IS NOT NULL AS hp, q.share IS NOT NULL AS hq, coalesce(p.share, 0) + 1e-10 AS p, coalesce(q.share, 0) + 1e-10 AS q FROM p FULL JOIN q ON p.key = q.key),
    r AS (SELECT sum(p / (SELECT sum(p) FROM b) * ln((p / (SELECT sum(p) FROM b)) / (q / (SELECT sum(q) FROM b)))) AS kl, count(*) FILTER (hp AND NOT hq) AS o FROM b)
    SELECT 'template_distribution_anomaly' AS type, CASE WHEN kl > 2 THEN 'high' ELSE 'medium' END AS severity, round(kl, 5) AS target_value FROM r WHERE kl > 1
    UNION ALL SELECT 'excessive_unique_templates', 'medium', round(o::DOUBLE, 5) FROM r WHERE o > 0.2 * (SELECT count(*) FROM q)""")
def c10(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf).withColumn("source", F.col("process"))
    return comp.anomalies(log, "error").where("type not like 'metric%'").select("type", "severity", F.round("target_value", 5).alias("target_value"))


@query("c12_no_baseline", "SELECT 'no_baseline' AS type, 'high' AS severity")
def c12(spark: SparkSession, sf: str) -> DataFrame:
    return comp.anomalies(sources(spark, sf).where("host = 'h0'"), "h0").select("type", "severity")


_QUALITY = SRC + """,
q0 AS (SELECT host AS source, count(*) AS total_logs, avg(regexp_matches(raw, '(?i)error|fail|exception|panic|fatal|crash')::INT) AS e, avg(regexp_matches(raw, '(?i)warn|deprecated')::INT) AS w,
       (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 3.6e9 AS hours FROM logs GROUP BY host),
q1 AS (SELECT source, count(*) AS u, count(*) FILTER (n = 1) AS rare, -sum(share * log2(share)) AS h FROM sh GROUP BY source),
g AS (SELECT host AS source, epoch_us(timestamp) - lag(epoch_us(timestamp)) OVER (PARTITION BY host ORDER BY timestamp, line_no) AS gap FROM logs),
q2 AS (SELECT source, count(*) FILTER (gap > 3600000000::BIGINT) AS gaps FROM g GROUP BY source),
q AS (SELECT *, [e > 0.02, w > 0.05, u < 10, rare / greatest(u, 1) > 0.3, total_logs < 100, h > 10, h < 2, gaps >= total_logs * 0.1] AS t FROM q0 JOIN q1 USING (source) JOIN q2 USING (source)),
s AS (SELECT *, round(greatest(0.0, 1.0 - list_sum(list_transform(list_zip(t, [0.3, 0.2, 0.2, 0.1, 0.3, 0.2, 0.1, 0.1]), lambda x: CASE WHEN x[1] THEN x[2]::DOUBLE ELSE 0.0::DOUBLE END))), 6) AS score,
      len(list_filter(t, lambda x: x)) AS n_issues FROM q),
v AS (SELECT *, score >= 0.7 AND n_issues <= 2 AS valid FROM s)"""


@query("q1_baseline_quality", f"WITH {_QUALITY} SELECT source, valid, score, CAST(n_issues AS INT) AS n_issues, total_logs, gaps AS large_time_gaps, round(h, 6) AS template_entropy, round(total_logs / hours, 5) AS logs_per_hour FROM v")
def q1(spark: SparkSession, sf: str) -> DataFrame:
    out = comp.quality(sources(spark, sf))
    return out.select("source", "valid", F.round("score", 6).alias("score"), F.size("issues").alias("n_issues"), "total_logs", "large_time_gaps", F.round("template_entropy", 6).alias("template_entropy"), F.round("logs_per_hour", 5).alias("logs_per_hour"))


@query("q2_time_consistency", f"WITH {_QUALITY} SELECT source, gaps AS large_time_gaps, gaps < total_logs * 0.1 AS time_consistency FROM v")
def q2(spark: SparkSession, sf: str) -> DataFrame:
    return comp.quality(sources(spark, sf)).select("source", "large_time_gaps", "time_consistency")


_MUTUAL = " UNION ALL ".join(f"SELECT source, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM v" for m, e in (("error_rate", "e"), ("warning_rate", "w"), ("template_entropy", "h"), ("logs_per_hour", "total_logs / hours")))


@query("q3_mutual_consistency", f"WITH {_QUALITY}, m AS ({_MUTUAL}), mm AS (SELECT *, avg(value) OVER (PARTITION BY metric) AS mean, stddev_pop(value) OVER (PARTITION BY metric) AS std FROM m) SELECT source, metric, round(value, 5) AS value, round(mean, 5) AS mean, round(std, 5) AS std FROM mm WHERE abs(value - mean) > 2 * std")
def q3(spark: SparkSession, sf: str) -> DataFrame:
    out = comp.mutual_consistency(comp.quality(sources(spark, sf)))
    return out.select("source", "metric", *[F.round(c, 5).alias(c) for c in ("value", "mean", "std")])


@query("q4_quality_summary", f"WITH {_QUALITY} SELECT count(*) AS total_files, count(*) FILTER (valid) AS valid_files, round(avg(score), 6) AS average_score, coalesce(string_agg(source, ',' ORDER BY source) FILTER (valid AND score >= 0.8), '') AS recommended FROM v")
def q4(spark: SparkSession, sf: str) -> DataFrame:
    return comp.quality_summary(comp.quality(sources(spark, sf))).withColumns({"average_score": F.round("average_score", 6), "recommended": F.array_join("recommended", ",")})


@query("q5_simple_quality_filter", f"WITH {_PROFILE}, r AS (SELECT *, CAST((error_rate > 0.02)::INT + (warning_rate > 0.05)::INT + (unique_templates < 10)::INT + (total_logs < 100)::INT + (rare_templates_count / greatest(unique_templates, 1) > 0.3)::INT AS INT) AS n_issues FROM prof JOIN ent USING (source)) SELECT source, n_issues, n_issues <= 1 AS usable FROM r")
def q5(spark: SparkSession, sf: str) -> DataFrame:
    return comp.simple_filter(sources(spark, sf))
