"""Positions, count-based windows and sequences over a totally ordered log.

Nothing here sorts the whole log in one task.  Positions come from counts per time bucket; ordered
neighbourhoods come from blocks of positions that each carry the rows they need from next door.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 1 << 16
#: Rows of a neighbourhood block: what is done to the rows after it runs in the same task, so there are many more blocks than cores.
NEAR = 1 << 12


def in_order(*more: str) -> list[Column]:
    """The canonical order: timestamp (nulls first), then line number."""
    return [F.col("timestamp").asc_nulls_first(), F.col("line_no").asc_nulls_first(), *[F.col(c) for c in more]]


def with_position(log: DataFrame, name: str = "pos", by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the 0-based place of each row in the canonical order, or in that of its rows of the same ``by``.

    A bucket is a minute (or, without timestamps, a block of line numbers); rows are numbered inside
    their bucket and shifted by the sizes of the buckets before it, a table with one row per bucket.
    """
    minute = F.floor(F.unix_micros(F.col("timestamp").cast("timestamp")) / 60_000_000)
    block = F.when(F.col("timestamp").isNull(), F.floor(F.coalesce(F.col("line_no"), F.lit(-1)) / BLOCK)).otherwise(F.lit(0))
    placed = log.withColumns({"__m": F.coalesce(minute, F.lit(-(1 << 62))), "__b": block})
    keys = [F.col(c) for c in by]
    before = W.partitionBy(*keys).orderBy("__m", "__b").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy(*keys, "__m", "__b").agg(F.count("*").alias("__n"))
    own = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    offsets = sizes.select(*own, F.col("__m").alias("__m_"), F.col("__b").alias("__b_"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    same = (F.col("__m") == F.col("__m_")) & (F.col("__b") == F.col("__b_"))
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{i}"))
    inside = W.partitionBy(*keys, "__m", "__b").orderBy(*in_order())
    return placed.join(offsets, same).withColumn(name, F.col("__o") + F.row_number().over(inside) - 1).drop("__m", "__b", "__o", "__m_", "__b_", *[f"__by{i}" for i in range(len(by))])


def with_blocks(rows: DataFrame, pos: str, before: int, after: int, size: int = NEAR) -> DataFrame:
    """Each row once for every block that needs it: ``__block``, and ``__core`` where the row is the block's own."""
    size = max(size, before, after)
    p = F.col(pos)
    blocks = F.sequence(F.greatest(F.floor((p - after) / size), F.lit(0)), F.floor((p + before) / size))
    return rows.withColumn("__block", F.explode(blocks)).withColumn("__core", F.col("__block") == F.floor(p / size))


def neighbourhood(pos: str, by: tuple[str, ...] = ()) -> W:
    return W.partitionBy(*by, "__block").orderBy(pos)


def in_windows(positioned: DataFrame, size: int = 50, stride: int = 25) -> DataFrame:
    """Each row once per window that holds it (``window_idx``): windows start at every ``stride``, tails are kept."""
    p = F.col("pos")
    first, last = F.greatest(F.lit(0), F.floor((p - size) / stride) + 1), F.floor(p / stride)
    return positioned.withColumn("window_idx", F.explode(F.when(first <= last, F.sequence(first, last))))


def template_codes(log: DataFrame, column: str = "template_id") -> DataFrame:
    """Adds ``code``: the rank of the template among the sorted ones from 0, -1 for null."""
    codes = vocabulary(log.select(F.col(column).alias("template")))
    return log.join(codes.select(F.col("template").alias("__t"), F.col("index").alias("__c")), F.col(column) == F.col("__t"), "left").withColumn("code", F.coalesce("__c", F.lit(-1)).cast("long")).drop("__t", "__c")


def vocabulary(log: DataFrame, column: str = "template") -> DataFrame:
    """(template, index): distinct templates numbered in order; one row per template."""
    distinct = log.select(F.col(column).alias("template")).where("template is not null").distinct()
    return distinct.withColumn("index", (F.row_number().over(W.orderBy("template")) - 1).cast("long"))


def window_counts(windowed: DataFrame) -> DataFrame:
    """(window_idx, code, cnt)."""
    return windowed.groupBy("window_idx", "code").agg(F.count("*").alias("cnt"))


def window_starts(windowed: DataFrame) -> DataFrame:
    """(window_idx, start_index): the line number of each window's first row."""
    return windowed.groupBy("window_idx").agg(F.min_by("line_no", "pos").alias("start_index"))


def count_matrix(counts: DataFrame, codes: list[int], starts: DataFrame) -> DataFrame:
    """Wide form for a sink: t0 .. tN and start_index; absent templates count 0, codes that aren't listed are dropped."""
    wide = counts.where(F.col("code").isin(codes)).groupBy("window_idx").pivot("code", codes).agg(F.sum("cnt"))
    named = wide.select("window_idx", *[F.col(f"`{c}`").alias(f"t{c}") for c in codes])
    return starts.join(named, "window_idx", "left").na.fill(0, [f"t{c}" for c in codes])


def encode(log: DataFrame, words: DataFrame, column: str = "template") -> DataFrame:
    """(line_no, timestamp, host, template_index): null where the template isn't in the vocabulary."""
    known = words.select(F.col("template").alias("__t"), F.col("index").cast("long").alias("template_index"))
    return log.join(known, F.col(column) == F.col("__t"), "left").select("line_no", "timestamp", "host", "template_index")


def contexts(sequence: DataFrame, length: int = 50, keep: int | None = None) -> DataFrame:
    """(idx, line_no, timestamp, host, context, target) of every row with ``length`` known rows before it.

    ``sequence``: (line_no, timestamp, host, template_index); rows without an index are dropped first.
    ``keep``: only the last so many of the context are carried.
    """
    keep = keep or length
    known = with_position(sequence.where("template_index is not null"))
    over = neighbourhood("pos").rowsBetween(-keep, -1)
    rows = with_blocks(known, "pos", keep, 0).withColumn("context", F.collect_list("template_index").over(over))
    return rows.where(F.col("__core") & (F.col("pos") >= length)).select((F.col("pos") - length).alias("idx"), "line_no", "timestamp", "host", "context", F.col("template_index").alias("target"))


def window_sequences(vectors: DataFrame, length: int = 20) -> DataFrame:
    """(window_idx, steps): overlapping runs of ``length`` window vectors (window_idx, v); fewer windows give one run padded with zeros."""
    over = neighbourhood("window_idx").rowsBetween(0, length - 1)
    n = vectors.count()
    if 0 < n < length:
        width = F.size(F.element_at("steps", 1))
        one = vectors.groupBy().agg(F.transform(F.sort_array(F.collect_list(F.struct("window_idx", "v"))), lambda x: x["v"]).alias("steps"))
        zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), length - n)
        return one.select(F.lit(0).cast("long").alias("window_idx"), F.concat("steps", zero).alias("steps"))
    rows = with_blocks(vectors, "window_idx", 0, length).withColumn("steps", F.collect_list("v").over(over))
    return rows.where(F.col("__core") & (F.size("steps") == length)).select("window_idx", "steps")


def adapt_width(vector: Column, width: int) -> Column:
    """Zero-padded on the right or cut to ``width``."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), width)), 1, width)


def first_seen(counts: DataFrame) -> DataFrame:
    """Adds ``is_new``: the window is the first one with this code.  One row per code is joined, so no task holds all windows of a common code."""
    first = counts.groupBy(F.col("code").alias("__code")).agg(F.min("window_idx").alias("__first"))
    return counts.join(first, F.col("code").eqNullSafe(F.col("__code")), "left").withColumn("is_new", F.col("window_idx") == F.col("__first")).drop("__code", "__first")


def gaps(log: DataFrame, by: str | None = None) -> DataFrame:
    """Adds ``gap_s``: seconds since the row before, in time order, of rows with a timestamp (per ``by``, or in all)."""
    timed = log.where("timestamp is not null")
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    if by is not None:
        return timed.withColumn("__p", F.lag("timestamp").over(W.partitionBy(by).orderBy(*in_order()))).withColumn("gap_s", seconds("timestamp") - seconds("__p")).drop("__p")
    rows = with_blocks(with_position(timed), "pos", 1, 0).withColumn("__p", F.lag("timestamp").over(neighbourhood("pos")))
    return rows.where("__core").withColumn("gap_s", seconds("timestamp") - seconds("__p")).drop("__p", "__block", "__core")


def transitions(log: DataFrame, column: str = "template_id") -> DataFrame:
    """(pos, line_no, from, to) of neighbours in the canonical order."""
    rows = with_blocks(with_position(log), "pos", 0, 1).withColumn("to", F.lead(column).over(neighbourhood("pos")))
    return rows.where("__core and to is not null").select("pos", "line_no", F.col(column).alias("from"), "to")


def context_lines(log: DataFrame, anchors: DataFrame, before: int = 3, after: int = 3, width: int = 1) -> DataFrame:
    """Rows of ``log`` whose line number lies in [anchor - before, anchor + width - 1 + after]: an equi join on exploded numbers, not a loop."""
    near = anchors.select(F.col("anchor"), F.explode(F.sequence(F.col("anchor") - before, F.col("anchor") + width - 1 + after)).alias("line_no"))
    inside = (F.col("line_no") >= F.col("anchor")) & (F.col("line_no") < F.col("anchor") + width)
    return log.join(near, "line_no").withColumn("is_anchor", inside)
