"""Samples of anomalous lines, analysis across methods, reports and diagnostics.

Only small results reach the driver: tables here are top-n lists, joins of them with the log, and counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import is_error, is_warning, reconstruction_severity
from . import windows as win
from .tables import quantiles, written


def top_anomalies(scores: DataFrame, n: int = 20, score: str = "score", key: str = "window_start_line") -> DataFrame:
    """The n anomalies with the highest score."""
    return scores.where("is_anomaly").orderBy(F.desc(score), key).limit(n)


def window_lines(log: DataFrame, chosen: DataFrame, size: int = 50, context: int = 3, key: str = "window_start_line") -> DataFrame:
    """Lines of each chosen window and of its surroundings: (anchor, is_anchor, columns of log)."""
    return win.context_lines(log, chosen.select(F.col(key).alias("anchor")), context, context, size)


def _top_templates(lines: DataFrame, key: str, n: int) -> DataFrame:
    counts = lines.where("template_id is not null").groupBy(key, "template_id").agg(F.count("*").alias("count"), F.min("line_no").alias("first"))
    ranked = counts.withColumn("r", F.row_number().over(W.partitionBy(key).orderBy(F.desc("count"), "first"))).where(F.col("r") <= n)
    return ranked.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "template_id", "count"))), lambda x: F.struct(x["template_id"].alias("template_id"), x["count"].alias("count"))).alias("dominant_templates"))


def window_patterns(lines: DataFrame, scores: DataFrame, key: str = "anchor") -> DataFrame:
    """One row per window of ``lines`` (anchor, columns of the log): dominant templates, error and warning counts, time density, indicators.

    ``scores``: (anchor, unseen_rate, freq_z).
    """
    t = F.unix_micros(F.col("timestamp").cast("timestamp")) / 1e6
    by = W.partitionBy(key).orderBy("timestamp", "line_no")
    timed = lines.withColumn("__gap", F.when(F.col("timestamp").isNotNull(), t - F.lag(t).over(by)))
    stats = timed.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.count_if(is_error("raw", "quality")).alias("error_log_count"), F.count_if(is_warning("raw", "quality")).alias("warning_log_count"),
        (F.count_distinct("template_id") + F.max(F.col("template_id").isNull().cast("int"))).alias("unique_templates"), F.count("timestamp").alias("__timed"),
        (F.max(t) - F.min(t)).alias("total_duration_seconds"), F.avg("__gap").alias("average_interval_seconds"), F.stddev_samp("__gap").alias("__sd"),
    )
    stats = stats.withColumns(
        {
            "error_percentage": F.col("error_log_count") / F.col("n_lines") * 100,
            "logs_per_second": F.when(F.col("__timed") >= 2, F.col("__timed") / F.greatest("total_duration_seconds", F.lit(1.0))),
            "time_distribution": F.when(F.col("__timed") < 2, F.lit(None)).when(F.col("__sd") < 0.5 * F.col("average_interval_seconds"), "concentrated").otherwise("spread"),
        }
    )
    both = stats.join(scores, key).join(_top_templates(lines, key, 3), key, "left")
    c = F.col
    rules = [("high_unseen_rate", c("unseen_rate") > 0.2), ("frequency_spike", c("freq_z") > 2.0), ("errors_found", c("error_log_count") > 0), ("many_warnings", c("warning_log_count") > 0.1 * c("n_lines")), ("high_diversity", c("unique_templates") > 0.8 * c("n_lines"))]
    return both.withColumn("anomaly_indicators", F.array_compact(F.array(*[F.when(w, F.lit(n)) for n, w in rules]))).drop("__timed", "__sd")


def representatives(lines: DataFrame, key: str = "anchor") -> DataFrame:
    """(anchor, type, line_no, raw): the first line of the most frequent template, the first error, and a line whose template occurs once."""
    counts = lines.where("template_id is not null").groupBy(key, "template_id").agg(F.count("*").alias("n"), F.min(F.struct("line_no", "raw")).alias("first"))
    pick = lambda name, expr: F.when(expr.isNotNull(), F.struct(F.lit(name).alias("type"), expr["line_no"].alias("line_no"), expr["raw"].alias("raw")))
    order = F.struct((-F.col("n")).alias("n"), F.col("first.line_no").alias("l"))
    dominant = counts.groupBy(key).agg(F.min_by("first", order).alias("d"), F.min(F.when(F.col("n") == 1, F.col("first"))).alias("rare"))
    errors = lines.groupBy(key).agg(F.min(F.when(is_error("raw", "sample"), F.struct("line_no", "raw"))).alias("e"))
    every = errors.join(dominant, key, "left").select(key, F.explode(F.array_compact(F.array(pick("dominant_template", F.col("d")), pick("error_log", F.col("e")), pick("rare_template", F.col("rare"))))).alias("x"))
    return every.select(key, "x.type", "x.line_no", "x.raw")


def locate_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """(alert_id, located_line, how): the alert's line, else a line of its time, else the first line of its host."""
    lines = log.select(F.col("line_no").alias("__l")).distinct()
    times = log.where("timestamp is not null").groupBy(F.col("timestamp").alias("__t")).agg(F.min("line_no").alias("by_time"))
    hosts = log.groupBy(F.col("host").alias("__h")).agg(F.min("line_no").alias("by_host"))
    found = alerts.join(lines, F.col("line_no") == F.col("__l"), "left").join(times, F.col("timestamp") == F.col("__t"), "left").join(hosts, F.col("entity") == F.col("__h"), "left")
    how = F.when(F.col("__l").isNotNull(), "line").when(F.col("by_time").isNotNull(), "time").when(F.col("by_host").isNotNull(), "host")
    return found.select("alert_id", F.coalesce("__l", "by_time", "by_host").alias("located_line"), how.alias("how"))


def failure_samples(verdicts: DataFrame, log: DataFrame, n: int = 20, context: int = 5, length: int = 50) -> DataFrame:
    """The first n failed predictions: the line, those around it, the last three transitions before it, and how varied the context is.

    ``verdicts``: (idx, line_no, target, in_topk, predicted).
    """
    failed = verdicts.where("not in_topk").orderBy("idx").limit(n).select("idx", F.col("line_no").alias("anchor"), "target", "predicted")
    positions = win.with_position(log.select("line_no", "timestamp", "template_id", "raw"))
    at = failed.join(positions.select(F.col("line_no").alias("anchor"), F.col("pos").alias("p")), "anchor")
    near = at.select("*", F.explode(F.sequence(F.col("p") - length, F.col("p") + context)).alias("pos")).join(positions, "pos")
    by = near.groupBy("idx", "anchor", "target", "predicted", "p")
    entry = F.struct("pos", "template_id")
    rows = by.agg(
        F.sort_array(F.collect_list(F.when(F.col("pos") <= F.col("p"), entry))).alias("s"),
        F.sort_array(F.collect_list(F.when(F.abs(F.col("pos") - F.col("p")) <= context, F.struct("pos", "raw")))).alias("around"),
    )
    names = F.transform("s", lambda x: x["template_id"])
    steps = F.zip_with(F.slice("seq", 1, F.size("seq") - 1), F.slice("seq", 2, F.size("seq")), lambda a, b: F.concat_ws(" -> ", a, b))
    return rows.withColumn("seq", names).select(
        "idx", F.col("anchor").alias("line_no"), "target", "predicted", F.element_at("seq", -1).alias("actual_template"),
        F.slice(steps, F.greatest(F.size("seq") - 3, F.lit(1)), 3).alias("recent_transitions"),
        (F.size(F.array_distinct("seq")) / F.size("seq")).alias("sequence_uniqueness"), F.transform("around", lambda x: x["raw"]).alias("context_lines"),
    )


def reconstruction_samples(found: DataFrame, log: DataFrame, n: int = 20, size: int = 50) -> DataFrame:
    """The n greatest reconstruction errors: error ratio, severity, and counts of their lines."""
    ratio = F.try_divide(F.col("reconstruction_error"), F.col("threshold"))
    chosen = found.where("is_anomaly").orderBy(F.desc("reconstruction_error"), "window_idx").limit(n)
    chosen = chosen.select("window_idx", F.col("start_index").alias("anchor"), "reconstruction_error", "threshold", ratio.alias("error_ratio"), reconstruction_severity(F.col("reconstruction_error"), F.col("threshold")).alias("severity"))
    lines = window_lines(log, chosen, size, 0, "anchor")
    stats = lines.groupBy("anchor").agg(F.count("*").alias("n_lines"), F.avg(is_error("raw", "analysis").cast("double")).alias("error_rate"), F.count_distinct("template_id").alias("unique_templates"))
    return chosen.join(stats, "anchor", "left").join(_top_templates(lines, "anchor", 5), "anchor", "left").withColumnRenamed("anchor", "start_index")


def template_samples(log: DataFrame, templates: DataFrame, n: int = 3) -> DataFrame:
    """(template_id, line_no, raw): up to n lines of each listed template, chosen by a hash, the same every time."""
    lines = log.join(F.broadcast(templates.select("template_id").distinct()), "template_id")
    by = W.partitionBy("template_id").orderBy(F.md5(F.col("line_no").cast("string")), "line_no")
    return lines.withColumn("__r", F.row_number().over(by)).where(F.col("__r") <= n).select("template_id", "line_no", "raw")


def spaced_samples(log: DataFrame, condition: Column, n: int = 5) -> DataFrame:
    """(line_no, raw): n lines that meet a condition, evenly spaced over all that do."""
    hits = win.with_position(log.where(condition), "pos")
    count = hits.agg(F.count("*").alias("__n"))
    places = count.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.greatest(F.col("__n") - 1, F.lit(0)) / F.lit(max(n - 1, 1)))))).alias("pos"))
    return hits.join(F.broadcast(places), "pos").select("line_no", "raw")


def error_stats(found: DataFrame) -> DataFrame:
    """One row over (reconstruction_error, is_anomaly)."""
    e = F.col("reconstruction_error")
    found = written(found.select("reconstruction_error", "is_anomaly"), "errors")
    out = found.agg(
        F.count("*").alias("total_windows"), F.count_if("is_anomaly").alias("anomalous_windows"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate"), F.avg(e).alias("mean"), F.stddev_samp(e).alias("std"),
        F.min(e).alias("min"), F.max(e).alias("max"),
    )
    return out.crossJoin(F.broadcast(quantiles(found, "reconstruction_error", {"median": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99})))


def anomaly_patterns(found: DataFrame, counts: DataFrame, n: int = 20, top: int = 5) -> DataFrame:
    """(window_idx, start_index, reconstruction_error, total_logs, unique_templates, top_templates) of the first n anomalous windows."""
    chosen = found.where("is_anomaly").orderBy("window_idx").limit(n).select("window_idx", "start_index", "reconstruction_error")
    cells = counts.where("code >= 0").join(F.broadcast(chosen.select("window_idx")), "window_idx")
    lists = cells.groupBy("window_idx").agg(F.sum("cnt").alias("total_logs"), F.count("*").alias("unique_templates"), F.slice(F.sort_array(F.collect_list(F.struct((-F.col("cnt")).alias("n"), "code"))), 1, top).alias("l"))
    return chosen.join(lists, "window_idx").select("window_idx", "start_index", "reconstruction_error", "total_logs", "unique_templates", F.transform("l", lambda x: F.concat(F.lit("t"), x["code"].cast("string"), F.lit(":"), (-x["n"]).cast("string"))).alias("top_templates"))


def method_overlap(found: DataFrame, scores: DataFrame, verdicts: DataFrame | None = None, stride: int = 25) -> DataFrame:
    """One row: windows that only one method, or both, call anomalous."""
    a = found.where("is_anomaly").select("window_idx").distinct().withColumn("m", F.lit(True))
    b = scores.where("is_anomaly").select(F.floor(F.col("window_start_line") / stride).alias("window_idx")).distinct().withColumn("b", F.lit(True))
    both = a.join(b, "window_idx", "full")
    m, s = F.col("m").isNotNull(), F.col("b").isNotNull()
    out = both.agg(F.count_if(m & ~s).alias("mscred_only"), F.count_if(s & ~m).alias("baseline_only"), F.count_if(m & s).alias("both_methods"), F.coalesce(F.try_divide(F.count_if(m & s), F.count("*")), F.lit(0.0)).alias("overlap_ratio"))
    if verdicts is not None:
        out = out.crossJoin(F.broadcast(verdicts.agg(F.count_if(~F.col("in_topk")).alias("deeplog_violations"))))
    return out


def histogram(values: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, n): equal-width bins between the least and the greatest value, numbered from 0; empty bins are left out."""
    edges = values.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    width = F.when(F.col("__hi") > F.col("__lo"), F.least(F.floor((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins), F.lit(bins - 1))).otherwise(0)
    return values.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(width.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def score_bins(scores: DataFrame, column: str = "score", bins: int = 5) -> DataFrame:
    """(bin, n): right-closed equal-width bins, as text charts use them: a value on an inner edge belongs to the lower bin."""
    edges = scores.agg(F.min(column).alias("__lo"), F.max(column).alias("__hi"))
    place = F.when(F.col("__hi") > F.col("__lo"), F.greatest(F.ceil(F.round((F.col(column) - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * bins, 9)) - 1, F.lit(0))).otherwise(0)
    return scores.where(F.col(column).isNotNull()).crossJoin(F.broadcast(edges)).groupBy(place.cast("long").alias("bin")).agg(F.count("*").alias("n"))


def report_summary(scores: DataFrame, verdicts: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """(method, total, anomalies, rate, severity) of each method that ran."""
    from ..functions.predicates import baseline_severity, deeplog_severity

    def row(name: str, df: DataFrame, flag: Column, severity) -> DataFrame:  # noqa: ANN001
        out = df.agg(F.lit(name).alias("method"), F.count("*").alias("total"), F.count_if(flag).alias("anomalies"), F.coalesce(F.avg(flag.cast("double")), F.lit(0.0)).alias("rate"))
        return out.withColumn("severity", severity(F.col("rate")))

    out = row("baseline", scores, F.col("is_anomaly"), baseline_severity)
    if verdicts is not None:
        out = out.unionByName(row("deeplog", verdicts, ~F.col("in_topk"), deeplog_severity))
    if found is not None:
        out = out.unionByName(row("mscred", found, F.col("is_anomaly"), baseline_severity))
    return out


def markdown_report(summary: DataFrame, top: DataFrame) -> str:
    """Text from two small tables."""
    lines = ["# Anomaly report", "", "| method | total | anomalies | rate | severity |", "|---|---|---|---|---|"]
    lines += [f"| {r.method} | {r.total} | {r.anomalies} | {r.rate:.1%} | {r.severity} |" for r in summary.collect()]
    lines += ["", "## Highest windows", ""]
    lines += [f"- line {r.window_start_line}: score {r.score:.3f}, unseen {r.unseen_rate:.1%}, spike {r.freq_z:.2f}" for r in top.collect()]
    return "\n".join(lines) + "\n"


def matrix_diagnostics(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row of two window-count tables (window_idx, code, cnt): codes on one side only, cells that differ, and shares of equal cells."""
    a, b = one.select("window_idx", "code", F.col("cnt").alias("x")), two.select("window_idx", "code", F.col("cnt").alias("y"))
    cells = a.join(b, ["window_idx", "code"], "full").select(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    ca, cb = one.select("code").distinct(), two.select("code").distinct()
    codes = ca.withColumn("p", F.lit(1)).join(cb.withColumn("q", F.lit(1)), "code", "full").agg(F.count_if(F.col("q").isNull()).alias("codes_only_first"), F.count_if(F.col("p").isNull()).alias("codes_only_second"))
    return cells.agg(F.count("*").alias("cells"), F.count_if(F.col("x") != F.col("y")).alias("cells_differing"), F.avg((F.col("x") == F.col("y")).cast("double")).alias("identical_share")).crossJoin(codes)


def normalisation_drift(one: DataFrame, two: DataFrame, limit: float = 0.05) -> DataFrame:
    """(code, mean_1, mean_2, std_1, std_2, drifted) of two tables (code, x): means or deviations more than ``limit`` apart, relatively."""
    stats = lambda df, i: df.groupBy("code").agg(F.avg("x").alias(f"mean_{i}"), F.stddev_pop("x").alias(f"std_{i}"))
    off = lambda c: F.abs(F.col(f"{c}_2") - F.col(f"{c}_1")) / F.greatest(F.abs(F.col(f"{c}_1")), F.lit(1e-8)) > limit
    return stats(one, 1).join(stats(two, 2), "code").withColumn("drifted", off("mean") | off("std"))


def region_ratio(errors: DataFrame, share: float = 0.8, limit: float = 1.5) -> DataFrame:
    """One row: mean error of the first ``share`` of windows (training) and of the rest, their ratio, and whether it is over ``limit``."""
    edge = errors.agg((F.max("window_idx") + 1).alias("n"))
    early = F.col("window_idx") < F.floor(F.col("n") * share)
    out = errors.crossJoin(F.broadcast(edge)).agg(F.avg(F.when(early, F.col("reconstruction_error"))).alias("train_mean"), F.avg(F.when(~early, F.col("reconstruction_error"))).alias("validation_mean"))
    ratio = F.try_divide(F.col("validation_mean"), F.col("train_mean"))
    return out.withColumns({"ratio": ratio, "overfit": ratio > limit})
