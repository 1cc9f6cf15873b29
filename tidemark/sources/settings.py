"""Configuration from files and the environment.

A TOML or JSON file gives sections ``roll``, ``retain``, ``max_page`` and the
plain values of ``Config``; variables such as ``TIDEMARK__ROLL__MAX_ROWS``
override it. Sizes may carry a unit: ``100MiB``, ``1 GB``.
"""

from __future__ import annotations

import dataclasses
import json
import os
import re
import tomllib
from collections.abc import Mapping
from typing import Any

from tidemark.operators.cursor import Limit

from .store import Config, Retention, Rolling

PREFIX = "TIDEMARK__"
_UNITS = {"": 1, "b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40}
_PARTS = {"roll": Rolling, "retain": Retention, "max_page": Limit}


def size(value: Any) -> int:
    """A number of bytes, with or without a unit."""
    if isinstance(value, int):
        return value
    m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([A-Za-z]*)\s*", str(value))
    if not m or m[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {value!r}")
    return int(float(m[1]) * _UNITS[m[2].lower()])


def _fill(kind: type, values: Mapping[str, Any]) -> Any:
    known = {f.name for f in dataclasses.fields(kind)}
    if odd := set(values) - known:
        raise ValueError(f"unknown settings: {', '.join(sorted(odd))}")
    return kind(**{k: (float(v) if k == "max_seconds" and v is not None else None if v is None else size(v)) for k, v in values.items()})


def load(path: str | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """The configuration of a store."""
    values: dict[str, Any] = {}
    if path:
        with open(path, "rb") as f:
            values = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    for k, v in (os.environ if environ is None else environ).items():
        if k.startswith(PREFIX):
            *section, name = k[len(PREFIX) :].lower().split("__")
            at = values
            for s in section:
                at = at.setdefault(s, {})
            at[name] = v
    parts = {k: _fill(kind, values.pop(k)) for k, kind in _PARTS.items() if k in values}
    return dataclasses.replace(_fill(Config, values), **parts)
