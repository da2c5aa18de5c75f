"""Log views of the driver's tables: one line per row, with the columns of a parsed log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, timestamp, host, process, raw, template_id, template) from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    code = F.concat_ws("_", "event_type", (k % 4).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("line_no"),
        F.col("ts").alias("timestamp"),
        F.concat(F.lit("h"), (F.col("user_id") % 8).cast("string")).alias("host"),
        F.col("event_type").alias("process"),
        F.concat(F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"), F.lit(" k="), k.cast("string")).alias("raw"),
        code.alias("template_id"),
        code.alias("template"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, host, process, raw) from the lines of ``documents``; no timestamps."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.posexplode(F.split("text", "\n")).alias("line", "raw"))
    return docs.select("doc_id", F.col("line").cast("long").alias("line"), F.col("source").alias("host"), F.col("lang").alias("process"), "raw")


def probe_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line_no, raw): ASCII messages that hold every kind of field the masks know, built from ``events``."""
    k = F.get_json_object("props", "$.k").cast("long")
    u, e = F.col("user_id"), F.col("event_id")
    h = lambda x, n: F.lpad(F.lower(F.hex(x)), n, "0")
    raw = F.concat(
        F.lit("open /var/log/u"), u.cast("string"), F.lit("/x.log at 0x"), h(e + 4096, 6), F.lit(" from 10.0."), (k % 256).cast("string"), F.lit("."), (u % 256).cast("string"),
        F.lit(" mac 00:1b:44:11:"), h(k % 256, 2), F.lit(":"), h(u % 256, 2), F.lit(" id 550e8400-e29b-41d4-a716-"), h(e, 12), F.lit(" v6 2001:0db8:85a3:0000:0000:8a2e:0370:"), h(k, 4),
        F.lit(" pid="), u.cast("string"), F.lit(" dev eth"), (k % 8).cast("string"), F.lit(" took "), (k - 50).cast("string"), F.lit(" load "), k.cast("string"), F.lit(".5 end"),
    )
    return table(spark, sf_dir, "events").select(e.alias("line_no"), raw.alias("raw"))
