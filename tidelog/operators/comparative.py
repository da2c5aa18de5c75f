"""Comparison of sources: profiles, distributions, divergences, metric tests, and baseline quality.

Everything is keyed by ``source``; one pass computes the profiles of all sources.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.predicates import is_error, is_warning, matches
from . import windows as win

METRICS = ("total_logs", "unique_templates", "error_rate", "warning_rate", "template_entropy", "rare_templates_count")
EPSILON = 1e-10


def distribution(log: DataFrame, column: str) -> DataFrame:
    """(source, key, n, share): templates as a share of all rows, other columns of the rows that have a value."""
    counts = log.groupBy("source", F.col(column).alias("key")).agg(F.count("*").alias("n"))
    by = W.partitionBy("source")
    whole = F.sum("n" if column == "template_id" else F.when(F.col("key").isNotNull(), F.col("n"))).over(by)
    return counts.withColumn("share", F.col("n") / whole).where("key is not null")


def entropy(distributions: DataFrame) -> DataFrame:
    """(source, entropy) in bits."""
    return distributions.groupBy("source").agg((-F.sum(F.col("share") * F.log2("share"))).alias("entropy"))


def rare_templates(log: DataFrame, top: int = 10) -> DataFrame:
    """(source, rare_templates_count, rare_templates): templates that occur once; the first ten by line."""
    counts = log.where("template_id is not null").groupBy("source", "template_id").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    once = F.when(F.col("n") == 1, F.struct("first", "template_id"))
    lists = counts.groupBy("source").agg(F.count_if(F.col("n") == 1).alias("rare_templates_count"), F.sort_array(F.collect_list(once)).alias("l"))
    return lists.select("source", "rare_templates_count", F.transform(F.slice("l", 1, top), lambda x: x["template_id"]).alias("rare_templates"))


def _span_hours() -> Column:
    return (F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))) / 3.6e9


def profiles(log: DataFrame) -> DataFrame:
    """One row per source: counts, rates, entropy, rare templates, duration and the three distributions."""
    base = log.groupBy("source").agg(
        F.count("*").alias("total_logs"), F.count_distinct("template_id").alias("unique_templates"), F.count_distinct("host").alias("unique_hosts"), F.count_distinct("process").alias("unique_processes"),
        F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), _span_hours().alias("duration_hours"),
        F.avg(is_error("raw").cast("double")).alias("error_rate"), F.avg(is_warning("raw").cast("double")).alias("warning_rate"),
    )
    base = base.withColumn("logs_per_hour", F.col("total_logs") / F.greatest("duration_hours", F.lit(1.0)))
    shares = distribution(log, "template_id")
    maps = {c: distribution(log, c).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "share")))).alias(f"{c.removesuffix('_id')}_distribution")) for c in ("template_id", "host", "process")}
    out = base.join(entropy(shares).withColumnRenamed("entropy", "template_entropy"), "source", "left").join(rare_templates(log), "source", "left")
    for m in maps.values():
        out = out.join(m, "source", "left")
    return out.na.fill(0.0, ["template_entropy"]).na.fill(0, ["rare_templates_count"])


def compare(target: DataFrame, baseline: DataFrame) -> DataFrame:
    """One row from two distributions (key, share): smoothed KL divergence, Jaccard, and common and exclusive keys."""
    both = target.select("key", F.col("share").alias("p")).join(baseline.select("key", F.col("share").alias("q")), "key", "full")
    both = both.select("key", F.col("p").isNotNull().alias("hp"), F.col("q").isNotNull().alias("hq"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("q", F.lit(0.0)).alias("q"))
    a, b = F.col("p") + EPSILON, F.col("q") + EPSILON
    # sum(p' ln(p'/q')) with p' = a / A, q' = b / B  =  sum(a ln(a/b)) / A + ln(B / A)
    kl = F.sum(a * F.log(a / b)) / F.sum(a) + F.log(F.sum(b) / F.sum(a))
    top = lambda c: F.transform(F.slice(F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.struct((-F.col(c)).alias("s"), "key")))), 1, 5), lambda x: x["key"])
    only = lambda cond: F.slice(F.sort_array(F.collect_list(F.when(cond, F.col("key")))), 1, 10)
    p_only, q_only, common = F.col("hp") & ~F.col("hq"), F.col("hq") & ~F.col("hp"), F.col("hp") & F.col("hq")
    return both.agg(
        F.coalesce(kl, F.lit(0.0)).alias("kl_divergence"), F.count_if(common).alias("common_templates"), F.count_if(p_only).alias("target_only_templates"), F.count_if(q_only).alias("baseline_only_templates"),
        F.coalesce(F.try_divide(F.count_if(common), F.count("*")), F.lit(0.0)).alias("jaccard_similarity"), top("p").alias("target_top_templates"), top("q").alias("baseline_top_templates"),
        only(p_only).alias("unique_in_target"), only(q_only).alias("missing_from_target"),
    )


def average_distribution(shares: DataFrame) -> DataFrame:
    """(key, share): the mean over sources; a source without the key counts 0."""
    n = shares.agg(F.count_distinct("source").alias("files"))
    return shares.groupBy("key").agg(F.sum("share").alias("s")).crossJoin(F.broadcast(n)).select("key", (F.col("s") / F.col("files")).alias("share"))


def metric_anomalies(target: DataFrame, baselines: DataFrame) -> DataFrame:
    """(type, severity, target_value, baseline_mean, baseline_std, z_score) of metrics over 2 deviations from the baselines' mean."""
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    long = lambda df: df.selectExpr(f"stack({len(METRICS)}, {stack}) as (metric, value)")
    stats = long(baselines).where("value is not null").groupBy("metric").agg(F.avg("value").alias("baseline_mean"), F.stddev_pop("value").alias("baseline_std"))
    z = F.abs(F.col("value") - F.col("baseline_mean")) / F.greatest("baseline_std", F.lit(1e-6))
    both = long(target).where("value is not null").join(F.broadcast(stats), "metric").withColumn("z_score", z).where("z_score > 2")
    return both.select(F.concat(F.lit("metric_anomaly_"), "metric").alias("type"), F.when(F.col("z_score") > 3, "high").otherwise("medium").alias("severity"), F.col("value").alias("target_value"), "baseline_mean", "baseline_std", "z_score")


def anomalies(log: DataFrame, target: str) -> DataFrame:
    """All anomalies of the source ``target`` against the other sources of ``log``.

    Without other sources there is one row, ``no_baseline``.  Template lists are under 11 entries, in order.
    """
    found = profiles(log)
    mine, others = found.where(F.col("source") == target), found.where(F.col("source") != target)
    none = lambda t: F.lit(None).cast(t)
    if others.limit(1).count() == 0:
        return log.sparkSession.range(1).select(F.lit("no_baseline").alias("type"), F.lit("high").alias("severity"), *[none("double").alias(c) for c in ("target_value", "baseline_mean", "baseline_std", "z_score")], none("array<string>").alias("templates"))
    shares = distribution(log, "template_id")
    average = average_distribution(shares.where(F.col("source") != target))
    row = compare(shares.where(F.col("source") == target), average).crossJoin(F.broadcast(average.agg(F.count("*").alias("size"))))
    kl = row.where("kl_divergence > 1").select(F.lit("template_distribution_anomaly").alias("type"), F.when(F.col("kl_divergence") > 2, "high").otherwise("medium").alias("severity"), F.col("kl_divergence").alias("target_value"), *[none("double").alias(c) for c in ("baseline_mean", "baseline_std", "z_score")], F.col("unique_in_target").alias("templates"))
    excess = row.where("target_only_templates > 0.2 * size").select(F.lit("excessive_unique_templates").alias("type"), F.lit("medium").alias("severity"), F.col("target_only_templates").cast("double").alias("target_value"), *[none("double").alias(c) for c in ("baseline_mean", "baseline_std", "z_score")], F.col("unique_in_target").alias("templates"))
    return metric_anomalies(mine, others).withColumn("templates", none("array<string>")).unionByName(kl).unionByName(excess)


@dataclass(frozen=True)
class QualityThresholds:
    max_error_rate: float = 0.02
    max_warning_rate: float = 0.05
    min_template_count: int = 10
    max_rare_template_ratio: float = 0.3
    min_log_count: int = 100
    max_template_entropy: float = 10.0
    min_template_entropy: float = 2.0
    min_score: float = 0.7


def quality(log: DataFrame, t: QualityThresholds = QualityThresholds()) -> DataFrame:
    """One row per source: its statistics, issues, score and whether it serves as a baseline."""
    counts = log.where("template_id is not null").groupBy("source", "template_id").agg(F.count("*").alias("n"))
    base = log.groupBy("source").agg(
        F.count("*").alias("total_logs"), F.avg(is_error("raw", "quality").cast("double")).alias("error_rate"), F.avg(is_warning("raw", "quality").cast("double")).alias("warning_rate"),
        F.count("timestamp").alias("timed"), _span_hours().alias("hours"),
    )
    share = F.col("n") / F.col("total_logs")
    stats = counts.join(base.select("source", "total_logs"), "source").groupBy("source").agg(F.count("*").alias("unique_templates"), F.count_if(F.col("n") == 1).alias("rare_templates"), (-F.sum(share * F.log2(share))).alias("template_entropy"))
    large = win.gaps(log, "source").groupBy("source").agg(F.count_if(F.col("gap_s") > 3600).alias("large_time_gaps"))
    every = base.join(stats, "source", "left").join(large, "source", "left").na.fill(0).na.fill(0.0, ["template_entropy"])
    every = every.withColumns(
        {
            "rare_template_ratio": F.col("rare_templates") / F.greatest("unique_templates", F.lit(1)),
            "time_consistency": (F.col("timed") <= 1) | (F.col("large_time_gaps") < F.col("total_logs") * 0.1),
            "logs_per_hour": F.when((F.col("total_logs") > 1) & (F.col("hours") > 0), F.col("total_logs") / F.col("hours")),
        }
    )
    c = F.col
    rules = [
        ("high_error_rate", 0.3, c("error_rate") > t.max_error_rate), ("high_warning_rate", 0.2, c("warning_rate") > t.max_warning_rate), ("few_templates", 0.2, c("unique_templates") < t.min_template_count),
        ("many_rare_templates", 0.1, c("rare_template_ratio") > t.max_rare_template_ratio), ("few_lines", 0.3, c("total_logs") < t.min_log_count), ("high_entropy", 0.2, c("template_entropy") > t.max_template_entropy),
        ("low_entropy", 0.1, c("template_entropy") < t.min_template_entropy), ("time_gaps", 0.1, ~c("time_consistency")),
    ]
    penalty = sum((F.when(cond, points).otherwise(0.0) for _, points, cond in rules), F.lit(0.0))
    issues = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, _, cond in rules]))
    scored = every.withColumns({"score": F.round(F.greatest(F.lit(0.0), 1.0 - penalty), 9), "issues": issues})
    valid = scored.withColumn("valid", (c("score") >= t.min_score) & (F.size("issues") <= 2))
    columns = ["total_logs", "unique_templates", "rare_templates", "rare_template_ratio", "template_entropy", "error_rate", "warning_rate", "time_consistency", "large_time_gaps", "logs_per_hour"]
    return valid.select("source", "valid", "score", "issues", *columns)


def mutual_consistency(valid: DataFrame) -> DataFrame:
    """(source, metric, value, mean, std) of baselines over 2 deviations from the mean of all of them; a metric needs two values."""
    names = ("error_rate", "warning_rate", "template_entropy", "logs_per_hour")
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in names)
    by = W.partitionBy("metric")
    long = valid.selectExpr("source", f"stack({len(names)}, {stack}) as (metric, value)").where("value is not null")
    long = long.withColumns({"mean": F.avg("value").over(by), "std": F.stddev_pop("value").over(by), "n": F.count("*").over(by)})
    return long.where((F.col("n") >= 2) & (F.abs(F.col("value") - F.col("mean")) > 2 * F.col("std"))).drop("n")


def quality_summary(checked: DataFrame, recommended: float = 0.8) -> DataFrame:
    """One row: totals, mean score, and the sources to use."""
    good = F.when(F.col("valid") & (F.col("score") >= recommended), F.col("source"))
    return checked.agg(F.count("*").alias("total_files"), F.count_if("valid").alias("valid_files"), F.avg("score").alias("average_score"), F.sort_array(F.collect_list(good)).alias("recommended"))


def simple_filter(log: DataFrame) -> DataFrame:
    """(source, n_issues, usable): the batch tool's rule, at most one of five issues."""
    per = log.groupBy("source").agg(F.count("*").alias("total"), F.count_distinct("template_id").alias("u"), F.max(F.col("template_id").isNull().cast("int")).alias("null_template"), F.avg(is_error("raw").cast("double")).alias("e"), F.avg(matches("raw", "warn").cast("double")).alias("w"))
    rare = log.where("template_id is not null").groupBy("source", "template_id").count().groupBy("source").agg(F.count_if(F.col("count") == 1).alias("rare"))
    every = per.join(rare, "source", "left").na.fill(0).withColumn("u", F.col("u") + F.col("null_template"))
    tests = [F.col("e") > 0.02, F.col("w") > 0.05, F.col("u") < 10, F.col("total") < 100, F.col("rare") / F.greatest("u", F.lit(1)) > 0.3]
    n = sum((t.cast("int") for t in tests), F.lit(0))
    return every.select("source", n.alias("n_issues"), (n <= 1).alias("usable"))
