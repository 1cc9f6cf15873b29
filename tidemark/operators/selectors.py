"""Partition selectors: exact names, or ``regex:`` patterns searched anywhere in the name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Linear-time engines have no look-around and no back-references; such patterns count as literal names.
_UNSAFE = re.compile(r"(?<!\\)(?:\\\\)*(?:\(\?<?[=!]|\\[1-9]|\\k<|\(\?>|[*+?}]\+)")
MAX_PATTERN = 10_000


def compile_pattern(spark: SparkSession, pattern: str) -> str | None:
    """The pattern for ``rlike``, or None if it isn't a valid safe pattern."""
    if len(pattern) > MAX_PATTERN or _UNSAFE.search(pattern):
        return None
    java = spark._jvm.java.util.regex.Pattern

    def valid(p: str) -> bool:
        try:
            java.compile(p)
            return True
        except Exception:  # noqa: BLE001 - whatever the JVM raises, the pattern is not valid
            return False

    # script names stand alone in the selectors' dialect; Java wants "Is" before them
    fixed = re.sub(r"\\([pP])\{(\w+)\}", lambda m: m[0] if valid(m[0]) else rf"\{m[1]}{{Is{m[2]}}}", pattern)
    return fixed if valid(fixed) else None


def partition_filter(spark: SparkSession, selectors: Sequence[str] | None, col: Column) -> Column:
    """A predicate on partition names: None selects all, an empty list none; the selectors are OR-ed."""
    if selectors is None:
        return F.lit(True)
    names, out = [], F.lit(False)
    for s in selectors:
        pattern = compile_pattern(spark, s[6:]) if s.startswith("regex:") else None
        if pattern is None:
            names.append(s)
        else:
            out = out | col.rlike(pattern)
    return (col.isin(names) | out) if names else out


def select_names(spark: SparkSession, selectors: Sequence[str] | None, names: Sequence[str]) -> list[str]:
    """The same on a list of names (a topic's partitions)."""
    if selectors is None:
        return list(names)
    exact, patterns = set(), []
    for s in selectors:
        p = compile_pattern(spark, s[6:]) if s.startswith("regex:") else None
        exact.add(s) if p is None else patterns.append(spark._jvm.java.util.regex.Pattern.compile(p))
    return [n for n in names if n in exact or any(p.matcher(n).find() for p in patterns)]
