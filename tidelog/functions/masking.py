"""Masking of variable fields in log messages: nine ordered replacements in one projection, no UDF.

``(?U)`` makes ``\\w``, ``\\d`` and ``\\b`` follow Unicode, as log tools written in Python do.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d\d?)"
_H = "[0-9a-fA-F]"

#: step -> (Java pattern, replacement), in the order of application
STEPS: dict[str, tuple[str, str]] = {
    "path": (r"(?U)[/~][\w.\-_/]+", "<PATH>"),
    "hex": (rf"(?U)0x{_H}+", "<HEX>"),
    "ipv4": (rf"(?U)\b(?:{_OCTET}\.){{3}}{_OCTET}\b", "<IP>"),
    "ipv6": (rf"(?U)\b(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}\b", "<IP6>"),
    "mac": (rf"(?U)\b(?:{_H}{{2}}:){{5}}{_H}{{2}}\b", "<MAC>"),
    "uuid": (rf"(?U)\b{_H}{{8}}-{_H}{{4}}-[1-5]{_H}{{3}}-[89abAB]{_H}{{3}}-{_H}{{12}}\b", "<UUID>"),
    "pid": (r"(?U)\b(pid|tid|uid|gid)=\d+\b", "$1=<ID>"),
    "device": (r"(?U)\b([a-zA-Z]+)(\d+)\b", "$1<ID>"),
    "number": (r"(?U)(?<![\w./\-])-?\d+(?:\.\d+)?(?![\w./\-])", "<NUM>"),
}

#: the looser profile of the line-at-a-time scorer: no word bounds, octets or guards
COMPAT_C: dict[str, tuple[str, str]] = {
    "path": (r"[/~][\w.\-_/]+", "<PATH>"),
    "hex": (rf"0x{_H}+", "<HEX>"),
    "ipv4": (r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", "<IP>"),
    "ipv6": (rf"(?:{_H}{{1,4}}:){{7}}{_H}{{1,4}}", "<IP6>"),
    "mac": (rf"(?:{_H}{{2}}:){{5}}{_H}{{2}}", "<MAC>"),
    "uuid": (rf"{_H}{{8}}-{_H}{{4}}-[1-5]{_H}{{3}}-[89abAB]{_H}{{3}}-{_H}{{12}}", "<UUID>"),
    "pid": (r"(pid|tid|uid|gid)=[0-9]+", "$1=<ID>"),
    "device": (r"([a-zA-Z]+)([0-9]+)", "$1<ID>"),
    "number": (r"-?[0-9]+(?:\.[0-9]+)?", "<NUM>"),
}


@dataclass(frozen=True)
class MaskConfig:
    """Which steps run; all by default."""

    path: bool = True
    hex: bool = True
    ipv4: bool = True
    ipv6: bool = True
    mac: bool = True
    uuid: bool = True
    pid: bool = True
    device: bool = True
    number: bool = True


def step(name: str, text: Column | str, steps: dict[str, tuple[str, str]] = STEPS) -> Column:
    pattern, replacement = steps[name]
    return F.regexp_replace(text, pattern, replacement)


def mask(text: Column | str, config: MaskConfig | None = None, steps: dict[str, tuple[str, str]] = STEPS) -> Column:
    """The whole chain over one column."""
    config = config or MaskConfig()
    out = F.col(text) if isinstance(text, str) else text
    for field in fields(config):
        if getattr(config, field.name):
            out = step(field.name, out, steps)
    return out
