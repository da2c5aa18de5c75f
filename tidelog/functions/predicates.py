"""Severity words and small scalar rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ERRORS = {
    "profile": "error|fail|exception|panic|fatal",
    "quality": "error|fail|exception|panic|fatal|crash",
    "sample": "error|fail|exception",
    "analysis": "error|fail|exception|warning|critical",
}
WARNINGS = {"profile": "warn", "quality": "warn|deprecated"}


def matches(text: Column | str, words: str) -> Column:
    """Case-insensitive; a null text has no match."""
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike(f"(?i){words}"), F.lit(False))


def is_error(text: Column | str, variant: str = "profile") -> Column:
    return matches(text, ERRORS[variant])


def is_warning(text: Column | str, variant: str = "profile") -> Column:
    return matches(text, WARNINGS[variant])


def is_error_exact_case(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(text.rlike("error|ERROR|fail|FAIL"), F.lit(False))


def ratio(a: Column, b: Column, floor: float = 1.0) -> Column:
    return a / F.greatest(b, F.lit(floor))


def clip(x: Column, low: float, high: float | Column) -> Column:
    return F.least(F.greatest(x, F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def baseline_severity(rate: Column) -> Column:
    return F.when(rate < 0.05, "normal").when(rate < 0.20, "caution").otherwise("high")


def deeplog_severity(rate: Column) -> Column:
    return F.when(rate < 0.20, "normal").when(rate < 0.50, "caution").otherwise("high")


def reconstruction_severity(error: Column, threshold: Column) -> Column:
    r = F.try_divide(error, threshold)
    return F.when(threshold <= 0, "medium").when(r >= 3.0, "high").when(r >= 1.5, "medium").otherwise("low")


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", x * 100)


def shortened(text: Column, width: int) -> Column:
    return F.when(F.length(text) > width, F.concat(F.substring(text, 1, width), F.lit("..."))).otherwise(text)
