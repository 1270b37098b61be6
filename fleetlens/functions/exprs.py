"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(a: Column, b: Column, scale: float = 1.0) -> Column:
    """scale * a / b, null where b is 0 or null."""
    return scale * a.cast("double") / F.when(b != 0, b.cast("double"))


def ladder(value: Column, steps: list[tuple[float, object]], default: object = 0.0, strict: bool = True) -> Column:
    """The result of the first step whose bound ``value`` exceeds (or reaches, if not strict); steps by falling bound."""
    out = None
    for bound, result in steps:
        test = value > bound if strict else value >= bound
        result = result if isinstance(result, Column) else F.lit(result)
        out = F.when(test, result) if out is None else out.when(test, result)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


# The forms in which SQL text may hold a credential.
CREDENTIALS = [
    (r"(?i)(password\s*=?\s*)'[^']*'", "$1'***'"),
    (r"(?i)(password=)[^\s'&;]+", "$1***"),
    (r"(?i)(://[^:/@\s]+:)[^@\s]+@", "$1***@"),
]
# What a log template masks, in this order.
MASKS = [r"'[^']*'|\"[^\"]*\"", r"\b[0-9a-fA-F]+/[0-9a-fA-F]+\b", r"\b0x[0-9a-fA-F]+\b", r"\d+(?:\.\d+)?"]


def sanitize(text: Column) -> Column:
    """SQL text without credentials."""
    for pattern, to in CREDENTIALS:
        text = F.regexp_replace(text, pattern, to)
    return text


def mask_template(text: Column, placeholder: str = "<*>") -> Column:
    """The template of a log line: white space collapsed, then quoted strings, log positions, hex and numbers masked."""
    text = F.trim(F.regexp_replace(text, r"[\s\x85\p{Z}]+", " "))
    for pattern in MASKS:
        text = F.regexp_replace(text, pattern, placeholder)
    return text


def hour_of_week(ts: Column) -> Column:
    """0 (Sunday, midnight UTC) to 167."""
    return (F.dayofweek(ts) - 1) * 24 + F.hour(ts)


def lsn_to_long(lsn: Column) -> Column:
    """A log position 'hi/lo' of two hex words as one number."""
    part = F.split(lsn, "/")
    return F.conv(part[0], 16, 10).cast("long") * F.lit(1 << 32) + F.conv(part[1], 16, 10).cast("long")
