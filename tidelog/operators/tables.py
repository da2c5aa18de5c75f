"""Tables written once and read several times, and exact quantiles of columns that no single task could hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ACCURACY = 10_000


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session.  Where a cluster names none, that is an error; a local session gets a temporary folder."""
    name = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not name:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        name = tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", name)
    return name.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: what follows reads that instead of planning and computing ``df`` again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def quantile(rows: DataFrame, column: str, q: float, name: str) -> DataFrame:
    """One row: one of :func:`quantiles`."""
    return quantiles(rows, column, {name: q})


def quantiles(rows: DataFrame, column: str, wanted: dict[str, float]) -> DataFrame:
    """One row: exact quantiles (linear between neighbours) of the values that aren't null, by name; null if there are none.

    A sketch, whose ranks are off by one in ACCURACY at most, gives bounds between which each quantile lies for certain (least and greatest value,
    where there are so few values that the neighbours' distance counts).  Values outside are only counted; of those between, a few in ACCURACY and
    ties, each different value is one row with its count, and only these rows are put in order.
    """
    values = rows.select(F.col(column).cast("double").alias("v")).where("v is not null")
    edge, few = 2 / ACCURACY, F.count("*") < 2 * ACCURACY
    sketch = F.percentile_approx("v", [min(max(q + d, 0.0), 1.0) for q in wanted.values() for d in (-edge, edge)], ACCURACY)
    ends = values.agg(few.alias("few"), F.min("v").alias("least"), F.max("v").alias("most"), sketch.alias("at"))
    low = [F.when(F.col("few") | F.lit(q <= edge), F.col("least")).otherwise(F.col("at")[2 * i]) for i, q in enumerate(wanted.values())]
    high = [F.when(F.col("few") | F.lit(q >= 1 - edge), F.col("most")).otherwise(F.col("at")[2 * i + 1]) for i, q in enumerate(wanted.values())]
    bounds = F.broadcast(ends.select(F.array(*low).alias("low"), F.array(*high).alias("high")))
    v = F.col("v")
    total = lambda array, test: F.aggregate(array, F.lit(0), lambda n, x: n + test(x).cast("int"))
    part = total("low", lambda x: v >= x) + total("high", lambda x: v > x)  # grows with v
    inside = F.exists(F.arrays_zip("low", "high"), lambda x: (v >= x["low"]) & (v <= x["high"]))
    counts = values.crossJoin(bounds).groupBy(part.alias("part"), F.when(inside, v).alias("v")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy("part", "v").rowsBetween(W.unboundedPreceding, 0))
    ordered = counts.select("v", upto.alias("upto"), (F.sum("n").over(W.partitionBy()) - 1).alias("last"))
    place = {name: F.lit(q) * F.col("last") for name, q in wanted.items()}
    neighbours = [F.min(F.when(F.col("upto") > f(place[name]), F.struct("upto", "v")))["v"].alias(f"{k}_{name}") for name in wanted for k, f in (("a", F.floor), ("b", F.ceil))]
    got = ordered.agg(F.max("last").alias("last"), *neighbours)

    def between(name: str) -> Column:
        a, b, at = F.col(f"a_{name}"), F.col(f"b_{name}"), place[name]
        return F.when(a == b, a).otherwise((F.ceil(at) - at) * a + (at - F.floor(at)) * b)

    return got.select(*[between(name).alias(name) for name in wanted])
