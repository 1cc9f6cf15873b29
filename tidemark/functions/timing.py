"""Epoch milliseconds and RFC 3339 texts."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_RFC3339 = re.compile(r"(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(\.\d+)?([Zz]|[+-]\d\d:\d\d)")


def parse_rfc3339(text: str) -> int:
    """Epoch milliseconds of an RFC 3339 time, truncated."""
    m = _RFC3339.fullmatch(text)
    if not m:
        raise ValueError(f"not an RFC 3339 time: {text!r}")
    micros = (m[3] or ".0")[1:7].ljust(6, "0")
    t = datetime.fromisoformat(f"{m[1]}T{m[2]}.{micros}" + (m[4] if m[4] not in "Zz" else "+00:00"))
    return (t - EPOCH) // timedelta(milliseconds=1)


def to_millis(value) -> int:
    """Epoch milliseconds of an int, an RFC 3339 text or a datetime (naive: UTC)."""
    if isinstance(value, bool):
        raise TypeError("a time can't be a boolean")
    if isinstance(value, int):
        return value
    if isinstance(value, str):
        return parse_rfc3339(value)
    if isinstance(value, datetime):
        return ((value if value.tzinfo else value.replace(tzinfo=timezone.utc)) - EPOCH) // timedelta(milliseconds=1)
    raise TypeError(f"not a time: {value!r}")


def millis(col: Column) -> Column:
    """Epoch milliseconds of a timestamp column, with or without zone (then: the session's)."""
    return F.unix_millis(col.cast("timestamp"))
