"""Bounded samples of labelled rows for fitting: chosen by a hash, without sorting or gathering the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bounded(rows: DataFrame, most: int, *key: str | Column) -> DataFrame:
    """The ``most`` rows (all, if there are no more) whose key hashes lowest, in a fixed order: the same ones for the same table whatever its partitions.

    Of rows with one key, those come first whose other columns are least.  The cut under which hashes are looked at follows from the number of rows, so about
    a fifth more than wanted leave their partitions; where keys repeat so often that too few lie under it, it is raised until there are enough.
    """
    n = rows.count()
    if n <= most:
        return rows.orderBy(*rows.columns)
    h = F.pmod(F.xxhash64(*key), F.lit(1 << 40))
    cut = min(1.0, 1.2 * most / n + 20 / n)
    while True:
        near = rows.withColumn("__h", h).where(F.col("__h") <= F.lit(int((1 << 40) * cut)))
        if cut >= 1 or near.count() >= most:
            return near.orderBy("__h", *rows.columns).limit(most).drop("__h")
        cut = min(1.0, 4 * cut)
