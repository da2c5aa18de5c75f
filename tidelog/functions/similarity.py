"""Nearest template by token and edit similarity, as expressions over a broadcast vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: beyond this many templates the vocabulary is not broadcast
BROADCAST_TEMPLATES = 50_000


def tokens(text: Column) -> Column:
    return F.slice(F.filter(F.split(text, "[ \t\n\r]+"), lambda x: x != ""), 1, 256)


def token_jaccard(a: Column, b: Column) -> Column:
    """Of token lists: tokens of ``a`` (each time they occur) that are in ``b``, over the rest of both."""
    both = F.size(F.filter(a, lambda x: F.array_contains(b, x)))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / union)


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def similarity(a: Column, b: Column, ta: Column, tb: Column) -> Column:
    """Token similarity alone where it is under 0.2 (the edit distance is then never computed), else 0.7 and 0.3 of both."""
    j = token_jaccard(ta, tb)
    return F.when(j < 0.2, j).otherwise(0.7 * j + 0.3 * edit_similarity(a, b))


def nearest_template(lines: DataFrame, vocabulary: DataFrame, text: str = "masked", floor: int = 50) -> DataFrame:
    """``lines`` (line_no, text) with the index of the most similar template (template, index), -1 under ``floor`` percent.

    Equal texts are matched once; of equal similarities the lowest index wins.
    """
    known = vocabulary.select(F.col("template").alias("__t"), F.col("index").cast("long").alias("__i"), tokens(F.col("template")).alias("__tt"))
    if known.limit(BROADCAST_TEMPLATES + 1).count() <= BROADCAST_TEMPLATES:
        known = F.broadcast(known)
    once = lines.select(F.col(text).alias("__x")).distinct().withColumn("__tx", tokens(F.col("__x")))
    s = F.floor(100 * similarity(F.col("__x"), F.col("__t"), F.col("__tx"), F.col("__tt"))).cast("int")
    best = once.crossJoin(known).groupBy("__x").agg(F.max(F.struct(s.alias("s"), (-F.col("__i")).alias("i"))).alias("b"))
    found = best.select("__x", F.col("b.s").alias("similarity"), F.when(F.col("b.s") >= floor, -F.col("b.i")).otherwise(F.lit(-1)).alias("predicted"))
    return lines.join(found, F.col(text).eqNullSafe(F.col("__x"))).drop("__x")
