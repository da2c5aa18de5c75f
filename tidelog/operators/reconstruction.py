"""Window reconstruction model: errors, thresholds from trained errors, and detection.

The default scorer projects standardised window sequences on their principal components and takes
the mean squared residual.  It stands in for a convolutional autoencoder (:mod:`.autoencoder`);
thresholds and detection are the same for both.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import quantile, quantiles, written

METHODS = {"99percentile": "threshold_99", "95percentile": "threshold_95", "99.9percentile": "threshold_99_9", "3sigma": "threshold_3sigma", "mad": "threshold_mad"}


def mean_squared_error(a: Column | str, b: Column | str) -> Column:
    """Of two arrays of equal length."""
    square = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.aggregate(square, F.lit(0.0), lambda s, x: s + x) / F.size(square)


def fit_pca(sequences: DataFrame, components: int = 8) -> PCAModel:
    """``sequences``: (window_idx, v) of flat vectors."""
    return PCA(k=components, inputCol="__v", outputCol="__p").fit(sequences.select(array_to_vector(F.col("v").cast("array<double>")).alias("__v")))


def pca_errors(sequences: DataFrame, model: PCAModel) -> DataFrame:
    """(window_idx, reconstruction_error): the mean squared part of each vector outside the components."""
    scored = model.transform(sequences.withColumn("__v", array_to_vector(F.col("v").cast("array<double>"))))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x)
    kept, whole = total(vector_to_array("__p")), total(F.col("v").cast("array<double>"))
    return scored.select("window_idx", (F.greatest(whole - kept, F.lit(0.0)) / F.size("v")).alias("reconstruction_error"))


def split(sequences: DataFrame, share: float = 0.8, order: str = "window_idx") -> tuple[DataFrame, DataFrame]:
    """The first ``share`` in order for training, the rest for validation."""
    n = sequences.count()
    cut = sequences.agg(F.percentile(order, F.lit(0.0)).alias("low"), F.max(order).alias("high")).first()
    edge = cut.low + int(share * n) if n and cut.high - cut.low == n - 1 else sequences.agg(F.percentile(order, F.lit(share))).first()[0]
    return sequences.where(F.col(order) < edge), sequences.where(F.col(order) >= edge)


def threshold_stats(errors: DataFrame, column: str = "reconstruction_error") -> DataFrame:
    """One row: percentiles 95, 99 and 99.9, mean + 3 deviations, and median + 3 scaled median deviations."""
    e = F.col(column)
    errors = written(errors.select(column), "errors")
    base = errors.agg(F.avg(e).alias("mean"), F.stddev_pop(e).alias("std"))
    shares = quantiles(errors, column, {"threshold_95": 0.95, "threshold_99": 0.99, "threshold_99_9": 0.999, "median": 0.5})
    base = written(base.crossJoin(F.broadcast(shares)), "stats")
    away = errors.crossJoin(F.broadcast(base.select("median"))).select(F.abs(e - F.col("median")).alias("away"))
    stats = base.crossJoin(F.broadcast(quantile(away, "away", 0.5, "mad")))
    return stats.select("threshold_95", "threshold_99", "threshold_99_9", "mean", "std", "median", "mad", (F.col("mean") + 3 * F.col("std")).alias("threshold_3sigma"), (F.col("median") + 3 * 1.4826 * F.col("mad")).alias("threshold_mad"))


def detect(errors: DataFrame, starts: DataFrame, stats: DataFrame | None = None, method: str = "99percentile", threshold: float | None = None) -> DataFrame:
    """(window_idx, start_index, reconstruction_error, is_anomaly, threshold); errors over the threshold are anomalies.

    The threshold is the given one, else that of the trained ``method`` (an unknown one means 99percentile), else the 95th percentile of these errors.
    """
    if threshold is not None:
        limit = errors.sparkSession.range(1).select(F.lit(float(threshold)).alias("threshold"))
    elif stats is None or method == "inference_adaptive":
        limit = quantile(errors, "reconstruction_error", 0.95, "threshold")
    else:
        limit = stats.select(F.col(METHODS.get(method, "threshold_99")).alias("threshold"))
    found = errors.join(starts, "window_idx").crossJoin(F.broadcast(limit))
    return found.select("window_idx", "start_index", "reconstruction_error", (F.col("reconstruction_error") > F.col("threshold")).alias("is_anomaly"), "threshold")
