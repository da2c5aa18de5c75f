"""Every query of the library by name, with its DuckDB statement where SQL can express it."""

from __future__ import annotations

from .registry import ORACLES, QUERIES
from . import analysis_queries, baseline_queries, scalar_queries, sequence_queries, source_queries, stream_queries  # noqa: F401  (importing registers)

__all__ = ["ORACLES", "QUERIES"]
