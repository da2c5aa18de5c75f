"""Batch analysis of many sources in one job: every per-file step is keyed by ``source``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import comparative as comp


def choose_target(log: DataFrame, target: str | None = None) -> str:
    """The named source, else the one with most lines (the first by name of equals)."""
    if target is not None:
        return target
    return log.groupBy("source").count().orderBy(F.desc("count"), "source").first()["source"]


def analyze(log: DataFrame, target: str | None = None) -> DataFrame:
    """Anomalies of the target against the other sources whose quality allows: (target, baselines, columns of comparative.anomalies).

    Where no other source is usable, all of them serve.
    """
    name = choose_target(log, target)
    usable = comp.simple_filter(log).where(F.col("usable") & (F.col("source") != name)).select("source")
    kept = usable if usable.limit(1).count() else log.where(F.col("source") != name).select("source").distinct()
    some = log.where(F.col("source") == name).unionByName(log.join(F.broadcast(kept), "source", "left_semi"))
    n = kept.agg(F.count("*").alias("baselines"))
    return comp.anomalies(some, name).crossJoin(F.broadcast(n)).select(F.lit(name).alias("target"), "baselines", "type", "severity", "target_value", "baseline_mean", "baseline_std", "z_score", "templates")
