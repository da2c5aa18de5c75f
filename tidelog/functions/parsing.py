"""Parsing of raw log lines: syslog, kernel ring buffer, or the bare line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SYSLOG = r"(?Ud)^([A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+([\w.\-]+)\s+([\w\-/.]+)(?:\[\d+\])?:\s+(.*)$"
DMESG = r"(?Ud)^\[\s*\d+\.\d+\]\s+(.*)$"
EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column | str) -> Column:
    """Without white space (of any script) at both ends."""
    return F.regexp_replace(text, EDGE_SPACE, "")


def timestamp(text: Column, year: int) -> Column:
    """``Sep 14 05:04:41`` in ``year``; null if it is no such time.  29 February is null: such lines carry no year."""
    flat = F.regexp_replace(text, r"(?U)\s+", " ")
    parsed = F.try_to_timestamp(F.concat(F.lit(f"{year} "), flat), F.lit("yyyy MMM d HH:mm:ss"))
    return F.when(flat.rlike("^Feb 29 "), None).otherwise(parsed)


def parse(lines: DataFrame, year: int, value: str = "value") -> DataFrame:
    """Adds ``timestamp``, ``host``, ``process`` and ``raw`` (the message); blank lines stay, with an empty message."""
    line = strip(value)
    part = lambda pattern, i: F.regexp_extract(line, pattern, i)
    syslog, dmesg = line.rlike(SYSLOG), line.rlike(DMESG)
    return lines.select(
        "*",
        F.when(syslog, timestamp(part(SYSLOG, 1), year)).alias("timestamp"),
        F.when(syslog, part(SYSLOG, 2)).alias("host"),
        F.when(syslog, part(SYSLOG, 3)).alias("process"),
        F.when(syslog, part(SYSLOG, 4)).when(dmesg, part(DMESG, 1)).otherwise(line).alias("raw"),
    )


FORMATS = (
    ("syslog", r"(?U)^\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}\s+\S+\s+\S+:"),
    ("timestamp_iso", r"(?U)^\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}"),
    ("timestamp_bracket", r"(?U)^\[\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\]"),
    ("apache_combined", r"(?U)^\S+\s+\S+\s+\S+\s+\["),
    ("json", r"(?U)^\s*\{.*\}\s*$"),
    ("generic", r"^."),
)


def format_priority(line: Column) -> Column:
    """0 for the most specific format that the line has; null if it is blank."""
    out = F.lit(None).cast("int")
    for i, (_, pattern) in reversed(list(enumerate(FORMATS))):
        out = F.when(line.rlike(pattern), i).otherwise(out)
    return out


def format_name(priority: Column) -> Column:
    out = F.when(priority.isNull(), "unknown")
    for i, (name, _) in enumerate(FORMATS):
        out = out.when(priority == i, name)
    return out
