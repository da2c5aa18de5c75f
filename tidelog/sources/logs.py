"""Log files: scans with line numbers, discovery, format sniffing, merging; and the sinks of each stage."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import masking
from ..functions.parsing import format_name, format_priority, strip

LOG_GLOBS = ("*.log", "*.log.*", "*.txt", "*.out", "*.err", "syslog*", "messages*", "kern*", "auth*", "*log")
SHELL_GLOBS = ("*.log", "*.log.*", "*.txt", "syslog*", "messages*", "kern.log*", "auth.log*")


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, value): lines numbered from 0 in each file; bytes that are no UTF-8 are dropped.

    Each split of a file numbers its own lines; the line counts of the splits before it are added, a table with
    one row per split.  No data move.
    """
    text = spark.read.text(list(paths)).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__id"),
        F.regexp_replace("value", "�", "").alias("value"),
    )
    splits = text.groupBy("path", "__start").agg(F.count("*").alias("__n"), F.min("__id").alias("__first"))
    before = W.partitionBy("path").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)
    offsets = splits.select("path", "__start", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    return text.join(offsets, ["path", "__start"]).select("path", (F.col("__o") + F.col("__id") - F.col("__first")).alias("line_no"), "value")


def concatenated(lines: DataFrame) -> DataFrame:
    """Files as one log in path order: (line_no, value, source)."""
    sizes = lines.groupBy("path").agg((F.max("line_no") + 1).alias("__n"))
    offsets = sizes.select("path", F.coalesce(F.sum("__n").over(W.orderBy("path").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__o"))
    return lines.join(offsets, "path").select((F.col("__o") + F.col("line_no")).alias("line_no"), "value", F.col("path").alias("source"))


def merged(parsed: dict[str, DataFrame]) -> DataFrame:
    """Parsed logs with a ``source`` column."""
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("source", F.lit(name)) for name, df in parsed.items()))


def discover(spark: SparkSession, folder: str, globs: tuple[str, ...] = LOG_GLOBS, max_depth: int = 3, limit: int | None = None) -> DataFrame:
    """(path, length): non-empty files whose name matches a glob, largest first; each file once.

    Folders whose name starts with a dot, and files deeper than ``max_depth``, are left out.  Only metadata are read.
    """
    pattern = "{" + ",".join(globs) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder).select("path", "length")
    root = folder.rstrip("/").removeprefix("file:")
    rest = F.split(F.element_at(F.split("path", root, 2), -1), "/")
    depth, hidden = F.size(rest) - 2, F.exists(F.slice(rest, 1, F.greatest(F.size(rest) - 1, F.lit(0))), lambda x: x.startswith("."))
    found = files.where((F.col("length") > 0) & (depth <= max_depth) & ~hidden).orderBy(F.desc("length"), "path")
    return found.limit(limit) if limit else found


def sniff(lines: DataFrame, sample: int = 10) -> DataFrame:
    """(path, format, total_lines): the most specific format among the first ``sample`` lines of each file."""
    first = F.when(F.col("line_no") < sample, format_priority(strip("value")))
    return lines.groupBy("path").agg(format_name(F.min(first)).alias("format"), F.count("*").alias("total_lines"))


def masked_export(lines: DataFrame, value: str = "value") -> DataFrame:
    """(value): whole lines, stripped and masked, without blank ones."""
    text = strip(value)
    return lines.where(text != "").select(masking.mask(text).alias("value"))


def preview(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The first ``n`` rows."""
    return df.orderBy(*order).limit(n)


def result_lines(df: DataFrame) -> DataFrame:
    """(value): one JSON object per row, escaped properly."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def dictionary_json(df: DataFrame, key: str, value: str) -> DataFrame:
    """(value): the whole two-column table as one JSON object, keys in order."""
    entries = F.sort_array(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))
    return df.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def dictionary_table(df: DataFrame, column: str = "value", key: str = "template", value: str = "index") -> DataFrame:
    """(key, value) rows of JSON dictionaries."""
    return df.select(F.explode(F.from_json(column, "map<string,bigint>")).alias(key, value))


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, sha256) of every file."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.sha2("content", 256).alias("sha256"))


def integrity(files: DataFrame, expected: list[tuple[str, bool]]) -> DataFrame:
    """(name, required, present, length): ``files`` (path, length) against the expected (name, required)."""
    spark = files.sparkSession
    want = spark.createDataFrame(expected, "name string, required boolean")
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    return want.join(have, "name", "left").select("name", "required", F.col("length").isNotNull().alias("present"), "length")
