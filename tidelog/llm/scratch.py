"""Tables written once and read again: lineage is cut in the shared folder, never on a machine's own disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


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
    """Write ``df`` as Parquet in the shared folder and read it back: a lost executor costs a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def count() -> int:
    """Tables that are stored now."""
    return len(_written)


def clear(spark: SparkSession, keep: int = 0, after: int = 0) -> None:
    """Delete what ``written`` has stored, but for the first ``after`` and the last ``keep`` tables; only when no frame that
    reads it is still needed."""
    jvm = spark.sparkContext._jvm
    gone = _written[after : len(_written) - keep]
    del _written[after : len(_written) - keep]
    for name in gone:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
