"""Streaming line scorer: a ring buffer of known templates per key, verdicts by a join with the trained successors.

State is the last few template numbers of a key.  The context of a line never holds the line itself;
unknown templates are anomalies and leave the buffer as it is; the first ``length`` known lines of a key are normal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CONTEXTS = "key string, line_no long, timestamp timestamp, template_index long, c2 long, c1 long, seen long"
STATE = "buffer array<long>, seen long"
UNKNOWN, VIOLATION, NORMAL = 0.8, 0.9, 0.1


#: Rows of a key that leave Python at a time.
SLICE = 50_000
#: A null line number, which comes first.
NONE = -(1 << 63)


def _contexts(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
    """Of a key's rows in this micro-batch, only plain numbers are held (time, line, template: 25 bytes a row, and their order); frames come and go in slices."""
    buffer, seen = state.get if state.exists else ([], 0)
    kept: list[list[np.ndarray]] = []
    for batch in batches:
        fine = batch["template_index"].notna().to_numpy()
        times = batch["timestamp"].to_numpy(dtype="datetime64[us]").astype(np.int64)  # NaT is the least number, so it comes first
        kept.append([times, batch["line_no"].astype("Int64").fillna(NONE).to_numpy(dtype=np.int64), batch["template_index"].fillna(0).to_numpy(dtype=np.int64), fine])
        del batch
    time, line, index, known = (np.concatenate([p.pop(0) for p in kept]) for _ in range(4))
    order = np.lexsort((line, time))
    values = np.concatenate([np.array(list(buffer), dtype=np.int64), index[order][known[order]]])
    place = len(buffer)  # of the next known row in values
    for low in range(0, len(order), SLICE):
        rows = order[low : low + SLICE]
        fine = known[rows]
        before = np.cumsum(fine) - fine  # known rows of this slice before each
        at = place + before

        def back(steps: int) -> pd.Series:
            there = at >= steps
            return pd.Series(values[np.where(there, at - steps, 0)] if len(values) else at, dtype="Int64").where(there)

        yield pd.DataFrame(
            {
                "key": key[0], "line_no": pd.Series(line[rows], dtype="Int64").where(line[rows] != NONE), "timestamp": pd.Series(time[rows].view("datetime64[us]")).astype("datetime64[ns]"),
                "template_index": pd.Series(index[rows], dtype="Int64").where(fine), "c2": back(2), "c1": back(1), "seen": seen + at - len(buffer),
            }
        )
        place += int(fine.sum())
    state.update((values[-2:].tolist(), int(seen + known.sum())))


def contexts(lines: DataFrame) -> DataFrame:
    """Of a stream (key, line_no, timestamp, template_index): each line with the two known templates before it.

    A key's lines of one micro-batch are put in order by one worker; limit what a trigger reads where keys are hot.
    """
    return lines.groupBy("key").applyInPandasWithState(_contexts, CONTEXTS, STATE, "append", "NoTimeout")


def batch_contexts(lines: DataFrame) -> DataFrame:
    """The same of a table."""
    by = W.partitionBy("key").orderBy(F.col("timestamp").asc_nulls_first(), "line_no").rowsBetween(W.unboundedPreceding, -1)
    known = F.col("template_index").isNotNull()
    last = by.rowsBetween(W.unboundedPreceding, -1)
    # number of known rows before, then the two latest of them by a running struct
    placed = lines.withColumn("seen", F.coalesce(F.sum(known.cast("long")).over(last), F.lit(0)))
    value = placed.where(known).select(F.col("key").alias("__k"), F.col("seen").alias("__s"), F.col("template_index").alias("__v"))
    one = value.select("__k", (F.col("__s") + 1).alias("__s1"), F.col("__v").alias("c1"))
    two = value.select(F.col("__k").alias("__k2"), (F.col("__s") + 2).alias("__s2"), F.col("__v").alias("c2"))
    joined = placed.join(one, (F.col("key") == F.col("__k")) & (F.col("seen") == F.col("__s1")), "left").join(two, (F.col("key") == F.col("__k2")) & (F.col("seen") == F.col("__s2")), "left")
    return joined.select("key", "line_no", "timestamp", "template_index", "c2", "c1", "seen")


def verdicts(context: DataFrame, predictions: DataFrame, length: int = 50) -> DataFrame:
    """(key, line_no, timestamp, is_anomaly, confidence, reason) of a table or a stream: ``predictions``, a table, as from ``sequence.predictions``."""
    found = context.join(predictions, ["c2", "c1"], "left")
    unknown, warm = F.col("template_index").isNull(), F.col("seen") < length
    hit = F.coalesce(F.array_contains("predicted", F.col("template_index")), F.lit(False))
    reason = F.when(unknown, "unknown_template").when(warm, "warm_up").when(hit, "predicted").otherwise("not_predicted")
    confidence = F.when(unknown, UNKNOWN).when(warm, NORMAL).when(hit, NORMAL).otherwise(VIOLATION)
    return found.select("key", "line_no", "timestamp", (unknown | (~warm & ~hit)).alias("is_anomaly"), confidence.alias("confidence"), reason.alias("reason"))


def changed_files(files: DataFrame, debounce: str = "60 seconds") -> DataFrame:
    """Of a stream (path, modificationTime): one row per file name within the debounce time."""
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.withWatermark("modificationTime", debounce).dropDuplicatesWithinWatermark(["name"])


def json_lines(scored: DataFrame) -> DataFrame:
    """(value): results as JSON, escaped properly."""
    return scored.select(F.to_json(F.struct("*")).alias("value"))
