"""Evaluation against labelled lines, comparison of models, and quality of a stored model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label_windows(scores: DataFrame, labels: DataFrame, size: int = 50, start: str = "window_start_line") -> DataFrame:
    """Adds ``truth``: whether any line of [start, start + size) is labelled anomalous.  An equi join on exploded line numbers of the anomalous lines' windows."""
    bad = labels.where("is_anomaly = 1").select("line_no").distinct()
    lines = scores.select(F.col(start).alias("__w"), F.explode(F.sequence(F.col(start), F.col(start) + size - 1)).alias("line_no"))
    hit = lines.join(bad, "line_no", "left_semi").select("__w").distinct().withColumn("truth", F.lit(True))
    return scores.join(hit, F.col(start) == F.col("__w"), "left").drop("__w").withColumn("truth", F.coalesce("truth", F.lit(False)))


def precision_recall(judged: DataFrame, predicted: Column | str = "is_anomaly", truth: Column | str = "truth", *keys: str) -> DataFrame:
    """(tp, fp, fn, tn, precision, recall, f1); 0 where a denominator is."""
    p, t = (F.col(c) if isinstance(c, str) else c for c in (predicted, truth))
    counts = judged.groupBy(*keys).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    out = counts.withColumns({"precision": zero(F.try_divide(tp, tp + fp)), "recall": zero(F.try_divide(tp, tp + fn))})
    pr, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", zero(F.try_divide(2 * pr * r, pr + r)))


def evaluate_baseline(scores: DataFrame, labels: DataFrame, size: int = 50) -> DataFrame:
    return precision_recall(label_windows(scores, labels, size))


def evaluate_sequences(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Of (line_no, in_topk): a failed prediction on an anomalous line is a hit; lines without a label take no part."""
    judged = verdicts.select("line_no", (~F.col("in_topk")).alias("p")).join(labels.select("line_no", (F.col("is_anomaly") == 1).alias("t")), "line_no")
    return precision_recall(judged, "p", "t")


def evaluate_by_block(flags: DataFrame, labels: DataFrame, size: int = 50) -> DataFrame:
    """Of (window_idx, is_anomaly): windows against the labels of their block of ``size`` lines, as far as both go."""
    block = labels.groupBy(F.floor(F.col("line_no") / size).alias("window_idx")).agg((F.max("is_anomaly") == 1).alias("truth"))
    return precision_recall(flags.select("window_idx", "is_anomaly").join(block, "window_idx"))


def method_results(results: dict[str, DataFrame]) -> DataFrame:
    """(method, total, anomalies, rate, mean_score) of result frames with (flag, score)."""
    out = None
    for name, df in results.items():
        row = df.agg(F.count("*").alias("total"), F.count_if("flag").alias("anomalies"), F.coalesce(F.avg(F.col("flag").cast("double")), F.lit(0.0)).alias("rate"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score")).select(F.lit(name).alias("method"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def compare_models(one: DataFrame, two: DataFrame) -> DataFrame:
    """(method, rate_1, rate_2, rate_diff, score_diff, verdict) of two ``method_results``: similar under 1 percentage point, notable from 5."""
    a = one.select("method", F.col("rate").alias("rate_1"), F.col("mean_score").alias("s1"))
    b = two.select("method", F.col("rate").alias("rate_2"), F.col("mean_score").alias("s2"))
    d = F.col("rate_2") - F.col("rate_1")
    verdict = F.when(F.abs(d) < 0.01, "similar").when(F.abs(d) < 0.05, "slightly different").otherwise("different")
    return a.join(b, "method").select("method", "rate_1", "rate_2", d.alias("rate_diff"), (F.col("s2") - F.col("s1")).alias("score_diff"), verdict.alias("verdict"))


def compare_files(one: DataFrame, two: DataFrame) -> DataFrame:
    """(name, length_1, length_2, status) of two listings (name, length): missing on a side, or sizes over 1 KB apart."""
    both = one.select("name", F.col("length").alias("length_1")).join(two.select("name", F.col("length").alias("length_2")), "name", "full")
    status = F.when(F.col("length_1").isNull(), "only second").when(F.col("length_2").isNull(), "only first").when(F.abs(F.col("length_1") - F.col("length_2")) > 1024, "size differs").otherwise("same")
    return both.withColumn("status", status)


def quality_score(checks: DataFrame) -> DataFrame:
    """(score, band) of one row (required_missing, corrupted, loadable, models, mean_f1, success_rate, max_memory_mb): 0 to 100."""
    c = F.col
    files = F.when(c("required_missing") == 0, 10.0).otherwise(0.0) + F.when(c("corrupted") == 0, 10.0).otherwise(0.0)
    loading = F.coalesce(F.try_divide(c("loadable"), c("models")) * 20, F.lit(0.0))
    memory = F.when(c("max_memory_mb") < 1000, 10.0).when(c("max_memory_mb") < 2000, 8.0).otherwise(5.0)
    score = F.least(files + loading + F.coalesce(c("mean_f1") * 30, F.lit(0.0)) + F.coalesce(c("success_rate") * 20, F.lit(0.0)) + memory, F.lit(100.0))
    band = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 70, "good").when(F.col("score") >= 50, "fair").otherwise("poor")
    return checks.withColumn("score", score).withColumn("band", band)
