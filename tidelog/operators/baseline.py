"""Baseline detector: frequency spikes and unseen templates in count-based windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows as win
from .tables import quantile, written

#: windows in a segment of the ordered fold, and windows of the past that a segment starts from: at least; more
#: where the weight of what is left out would exceed LEAST_WEIGHT, far under the precision of a double
SEGMENT, HALO, LEAST_WEIGHT = 512, 256, 1e-17


def halo(alpha: float) -> int:
    """Windows of the past that a segment starts from: (1 - alpha)**n is under LEAST_WEIGHT."""
    return max(HALO, math.ceil(math.log(LEAST_WEIGHT) / math.log1p(-alpha)) + 1 if alpha < 1 else 1)


@dataclass(frozen=True)
class BaselineParams:
    window_size: int = 50
    stride: int = 25
    ewm_alpha: float = 0.3
    anomaly_quantile: float = 0.95


def ewm_scores(counts: DataFrame, alpha: float) -> DataFrame:
    """(window_idx, code, cnt, mean, variance, z) of each observed count.

    Exponentially weighted mean and unbiased variance over the windows in which a template occurs; weights
    decay over the windows between.  A fold over each template's sorted counts, inside the JVM; long histories are
    folded in segments.
    """
    w = F.col("window_idx")
    past = halo(alpha)
    length = max(SEGMENT, past)
    segments = F.sequence(F.floor(w / length), F.floor((w + past) / length))
    rows = counts.select("code", "window_idx", "cnt", F.explode(segments).alias("segment"))
    entry = F.struct(w.alias("w"), F.col("cnt").cast("double").alias("x"))
    lists = rows.groupBy("code", "segment").agg(F.sort_array(F.collect_list(entry)).alias("obs"))

    keep = F.lit(1 - alpha)
    a = F.lit(alpha)
    double = lambda v: F.lit(v).cast("double")
    start = F.struct(
        F.lit(-1).cast("long").alias("w"), double(0.0).alias("mean"), double(0.0).alias("b"), double(1.0).alias("s2"),
        F.array().cast("array<struct<w:bigint,x:double,mean:double,b:double,s2:double>>").alias("out"),
    )

    def fold(s: Column, o: Column) -> Column:
        first = s["w"] < 0
        old = F.pow(keep, (o["w"] - s["w"]).cast("double"))
        total = old + a
        mean = F.when(first, o["x"]).otherwise((old * s["mean"] + a * o["x"]) / total)
        b = F.when(first, double(0.0)).otherwise((old * (s["b"] + F.pow(s["mean"] - mean, 2)) + a * F.pow(o["x"] - mean, 2)) / total)
        s2 = F.when(first, double(1.0)).otherwise((old * old * s["s2"] + a * a) / (total * total))
        row = F.struct(o["w"].alias("w"), o["x"].alias("x"), mean.alias("mean"), b.alias("b"), s2.alias("s2"))
        return F.struct(o["w"].alias("w"), mean.alias("mean"), b.alias("b"), s2.alias("s2"), F.concat(s["out"], F.array(row)).alias("out"))

    folded = lists.select("code", "segment", F.explode(F.aggregate("obs", start, fold, lambda s: s["out"])).alias("o"))
    own = folded.where(F.floor(F.col("o.w") / length) == F.col("segment"))
    variance = F.when(F.col("o.s2") < 1, F.col("o.b") / (1 - F.col("o.s2")))
    z = F.coalesce(F.greatest(F.lit(0.0), (F.col("o.x") - F.col("o.mean")) / F.sqrt(F.greatest(variance, F.lit(1e-9)))), F.lit(0.0))
    return own.select(F.col("o.w").alias("window_idx"), "code", F.col("o.x").cast("long").alias("cnt"), F.col("o.mean").alias("mean"), variance.alias("variance"), F.when(variance.isNull(), 0.0).otherwise(z).alias("z"))


def window_features(log: DataFrame, params: BaselineParams = BaselineParams(), column: str = "template_id") -> DataFrame:
    """(window_idx, window_start_line, freq_z, unseen_rate)."""
    coded = log.select("line_no", "timestamp", F.coalesce(F.col(column), F.lit("\0")).alias("code"))
    windowed = win.in_windows(win.with_position(coded), params.window_size, params.stride)
    counts = written(windowed.groupBy("window_idx", "code").agg(F.count("*").alias("cnt"), F.min_by("line_no", "pos").alias("line"), F.min("pos").alias("pos")), "counts")
    scored = ewm_scores(counts, params.ewm_alpha).select("window_idx", "code", "z")
    both = win.first_seen(counts).join(scored, ["window_idx", "code"])
    return both.groupBy("window_idx").agg(
        F.min_by("line", "pos").alias("window_start_line"),
        F.max("z").alias("freq_z"),
        (F.sum(F.col("is_new").cast("int")) / F.greatest(F.lit(1), F.count("*"))).alias("unseen_rate"),
    )


def score(features: DataFrame, anomalous: float = 0.95) -> DataFrame:
    """(window_start_line, unseen_rate, freq_z, freq_norm, unseen_norm, score, is_anomaly).

    Scores are rounded to 9 digits before the quantile, so that equal scores stay equal; a score on the quantile is an anomaly.
    """
    cap = quantile(features, "freq_z", 0.95, "__cap").select(F.greatest(F.lit(1e-9), "__cap").alias("__cap"))
    scored = features.crossJoin(F.broadcast(cap)).withColumns({"freq_norm": F.least(F.greatest("freq_z", F.lit(0.0)), "__cap") / F.col("__cap"), "unseen_norm": F.least(F.greatest("unseen_rate", F.lit(0.0)), F.lit(1.0))})
    scored = scored.withColumn("score", F.round(0.6 * F.col("freq_norm") + 0.4 * F.col("unseen_norm"), 9))
    limit = quantile(scored, "score", anomalous, "__limit")
    return scored.crossJoin(F.broadcast(limit)).select("window_start_line", "unseen_rate", "freq_z", "freq_norm", "unseen_norm", "score", (F.col("score") >= F.col("__limit")).alias("is_anomaly"))


def detect(log: DataFrame, params: BaselineParams = BaselineParams(), column: str = "template_id") -> DataFrame:
    """Scores of every window of a parsed log.  A log without lines is an error.

    Features, a row per window, are written once; the score and all that is made from it read them.
    """
    features = written(window_features(log, params, column), "features")
    if features.isEmpty():
        raise ValueError("the log has no lines, so no windows")
    return written(score(features, params.anomaly_quantile), "scores")


def normal_stats(scores: DataFrame) -> DataFrame:
    """One row: means and sample deviations over the windows that aren't anomalies."""
    normal = ~F.col("is_anomaly")
    out = [F.count("*").alias("total_windows"), F.count_if(normal).alias("normal_windows"), F.avg(F.col("is_anomaly").cast("double")).alias("anomaly_rate")]
    for column in ("unseen_rate", "freq_z", "score"):
        value = F.when(normal, F.col(column))
        out += [F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{column}"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias(f"std_{column}")]
    return scores.agg(*out)


def enhance(scores: DataFrame, stats: DataFrame) -> DataFrame:
    """Scores against trained statistics: z-scores, their norm, and whether it exceeds its 95th percentile."""
    s = F.broadcast(stats.select(*[F.col(c).alias(f"__{c}") for c in ("mean_unseen_rate", "std_unseen_rate", "mean_freq_z", "std_freq_z")]))
    z = lambda c: (F.col(c) - F.col(f"__mean_{c}")) / (F.col(f"__std_{c}") + 1e-8)
    out = scores.crossJoin(s).withColumns({"unseen_rate_zscore": z("unseen_rate"), "freq_zscore": z("freq_z")})
    out = out.withColumn("anomaly_score", F.round(F.sqrt(F.col("unseen_rate_zscore") ** 2 + F.col("freq_zscore") ** 2), 9))
    limit = quantile(out, "anomaly_score", 0.95, "__limit")
    return out.crossJoin(F.broadcast(limit)).withColumn("is_strong_anomaly", F.col("anomaly_score") > F.col("__limit")).select(*scores.columns, "unseen_rate_zscore", "freq_zscore", "anomaly_score", "is_strong_anomaly")


def merged_log(*logs: DataFrame) -> DataFrame:
    """Union for retraining.  Line numbers of later logs are shifted past those of earlier ones, so they stay unique."""
    offset, out = F.lit(0), None
    for log in logs:
        shifted = log.withColumn("line_no", F.col("line_no") + offset)
        out = shifted if out is None else out.unionByName(shifted)
        top = log.agg(F.coalesce(F.max("line_no") + 1, F.lit(0))).first()[0]
        offset = offset + F.lit(top)
    return out


def incremental(old: DataFrame, new: DataFrame, params: BaselineParams = BaselineParams()) -> DataFrame:
    """Statistics after retraining on old and new lines, beside those of the old lines alone."""
    before = normal_stats(detect(old, params)).select(F.col("normal_windows").alias("previous_normal_windows"))
    after = normal_stats(detect(merged_log(old, new), params))
    both = after.crossJoin(F.broadcast(before))
    return both.withColumns({"added_normal_windows": F.col("normal_windows") - F.col("previous_normal_windows"), "improvement_ratio": F.col("normal_windows") / F.greatest("previous_normal_windows", F.lit(1))})
