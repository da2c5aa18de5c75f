"""Raw lines to the parsed table: parse, mask, mine, in the canonical order's columns."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions import masking, parsing
from . import drain

COLUMNS = ("line_no", "timestamp", "host", "process", "raw", "masked", "template_id", "template")


@dataclass(frozen=True)
class ParseConfig:
    """``mining``: exact, distinct or none."""

    year: int = 1970
    mask: masking.MaskConfig = field(default_factory=masking.MaskConfig)
    mining: str = "exact"
    drain: drain.DrainParams = field(default_factory=drain.DrainParams)


def parse_log(lines: DataFrame, config: ParseConfig, state: DataFrame | None = None, source: str | None = None) -> DataFrame:
    """(line_no, timestamp, host, process, raw, masked, template_id, template) of lines (line_no, value)."""
    parsed = parsing.parse(lines, config.year).withColumn("masked", masking.mask("raw", config.mask)).drop("value")
    if config.mining == "none":
        mined = drain.without_miner(parsed)
    elif config.mining == "distinct":
        mined = drain.mine_distinct(parsed, config.drain)
    else:
        mined = drain.mine(parsed, config.drain, state, source)
    return mined.select(*COLUMNS, *([source] if source else []))
