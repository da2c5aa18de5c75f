"""Temporal analyzer: profiles by hour and weekday, and deviations from them.

The profile and the target may be different logs; by default they are the same one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def period(log: DataFrame) -> DataFrame:
    """(start, end, total_days): whole days between the first and the last timestamp, plus one."""
    seconds = F.unix_micros(F.max("timestamp").cast("timestamp")) - F.unix_micros(F.min("timestamp").cast("timestamp"))
    return log.agg(F.min("timestamp").alias("start"), F.max("timestamp").alias("end"), (F.floor(seconds / 86_400_000_000) + 1).alias("total_days"))


def _profile(log: DataFrame, unit: str, top: int) -> DataFrame:
    """(unit, n, unique_templates, template_distribution, top_templates); a null template counts as one of the unique ones.

    Templates are ranked by count, then by their first line.
    """
    field = F.hour("timestamp") if unit == "hour" else F.weekday("timestamp")
    counts = log.where("timestamp is not null").groupBy(field.alias(unit), "template_id").agg(F.count("*").alias("c"), F.min("line_no").alias("first"))
    by = W.partitionBy(unit)
    known = F.sum(F.when(F.col("template_id").isNotNull(), F.col("c"))).over(by)
    order = by.orderBy(F.col("template_id").isNull(), F.desc("c"), "first")
    ranked = counts.withColumns({"share": F.col("c") / known, "rank": F.row_number().over(order)})
    named = F.col("template_id").isNotNull()
    entry = F.when(named, F.struct("rank", "template_id", "share"))
    lists = ranked.groupBy(unit).agg(F.sum("c").alias("n"), F.count("*").alias("unique_templates"), F.sort_array(F.collect_list(entry)).alias("l"))
    return lists.select(
        unit,
        "n",
        "unique_templates",
        F.map_from_entries(F.transform("l", lambda x: F.struct(x["template_id"], x["share"]))).alias("template_distribution"),
        F.transform(F.slice("l", 1, top), lambda x: x["template_id"]).alias("top_templates"),
    )


def hourly_profile(log: DataFrame) -> DataFrame:
    """(hour, volume_mean, volume_std, template_distribution, top_templates, unique_templates)."""
    days = period(log).select("total_days")
    return _profile(log, "hour", 5).crossJoin(F.broadcast(days)).select("hour", (F.col("n") / F.col("total_days")).alias("volume_mean"), (F.col("n") * 0.1).alias("volume_std"), "template_distribution", "top_templates", "unique_templates")


def weekday_profile(log: DataFrame) -> DataFrame:
    """(weekday, volume_mean, template_distribution, top_templates, unique_templates); 0 is Monday."""
    days = period(log).select("total_days")
    return _profile(log, "weekday", 10).crossJoin(F.broadcast(days)).select("weekday", (F.col("n") / (F.floor(F.col("total_days") / 7) + 1)).alias("volume_mean"), "template_distribution", "top_templates", "unique_templates")


def anomalies(target: DataFrame, profile: DataFrame) -> DataFrame:
    """(type, hour, severity, actual_volume, expected_volume, deviation, templates): rows for hours that the profile lacks, volumes off
    by more than half, many templates outside the hour's top ones, and top ones that are missing."""
    seen = target.where("timestamp is not null").groupBy(F.hour("timestamp").alias("hour")).agg(F.count("*").alias("n"), F.collect_set("template_id").alias("actual"))
    both = seen.join(F.broadcast(profile.select("hour", "volume_mean", "top_templates")), "hour", "left")
    deviation = F.abs(F.col("n") - F.col("volume_mean")) / F.greatest("volume_mean", F.lit(1.0))
    new, gone = F.sort_array(F.array_except("actual", "top_templates")), F.sort_array(F.array_except("top_templates", "actual"))
    none = F.lit(None)
    row = lambda kind, when, severity, d=none, t=none: F.when(when, F.struct(F.lit(kind).alias("type"), severity.alias("severity"), d.cast("double").alias("deviation"), t.cast("array<string>").alias("templates")))
    known = F.col("volume_mean").isNotNull()
    kinds = F.array(
        row("temporal_unseen_hour", ~known, F.lit("high")),
        row("temporal_volume_anomaly", known & (deviation > 0.5), F.when(deviation > 1.0, "high").otherwise("medium"), deviation),
        row("temporal_new_templates", known & (F.size(new) > 0) & (F.size(new) > 0.2 * F.size("top_templates")), F.lit("medium"), none, new),
        row("temporal_missing_templates", known & (F.size(gone) > 0), F.lit("medium"), none, gone),
    )
    return both.select("hour", F.col("n").alias("actual_volume"), F.col("volume_mean").alias("expected_volume"), F.explode(F.array_compact(kinds)).alias("x")).select("x.type", "hour", "x.severity", "actual_volume", "expected_volume", "x.deviation", "x.templates")


def analyze(target: DataFrame, profile_log: DataFrame | None = None) -> DataFrame:
    return anomalies(target, hourly_profile(profile_log if profile_log is not None else target))
