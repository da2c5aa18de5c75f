"""Tables with every awkward row: nulls, empty and very long texts, repeats, and columns with clashing names."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = "id long, label string, sig string, bands string, start int, stop int, block string, epoch string, block_order string, key string, a int, b int"


def words(seed: int, n: int, vocabulary: int = 5000) -> str:
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary):x}" for _ in range(n))


def documents(spark: SparkSession, rows: list[tuple], clash: bool = False) -> DataFrame:
    """rows: (doc_id, text) or (doc_id, text, lang, source)."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    if clash:
        extra = spark.createDataFrame([(7, "x", "y", "z", 1, 2, "b", "e", "o", "k", 3, 4)], CLASHING)
        df = df.crossJoin(extra)
    return df


AWKWARD = [(100, None), (101, ""), (102, "   \n\t "), (None, words(9, 80)), (103, "one"), (104, "Été 한글 \U0001f600"), (105, words(5, 30_000)), (106, "same same same"), (106, "same same same")]
