"""Cursors, limits, orders and page statuses."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum
from typing import Any

DEFAULT_PAGE_ROWS = 1000
MAX_PAGE_ROWS = 10_000
MAX_PAGE_BYTES = 10_240_000

#: A cursor: the next position of each partition.
Cursor = dict[str, int]


class InvalidQuery(ValueError):
    pass


class Order(Enum):
    FORWARD = "asc"
    REVERSE = "desc"

    @classmethod
    def parse(cls, value: Order | str | None) -> Order:
        if value is None or isinstance(value, Order):
            return value or cls.FORWARD
        try:
            return cls(value.lower())
        except ValueError:
            raise InvalidQuery(f"unknown order {value!r}") from None


class Status(Enum):
    ALL = "All"
    SCHEMA_CHANGE = "SchemaChange"
    RECORD_LIMITED = "RecordLimited"
    BYTE_LIMITED = "ByteLimited"


@dataclass(frozen=True)
class Limit:
    """Rows and bytes of a page. The byte limit is by chunk: the chunk that reaches it is returned whole."""

    max_records: int = MAX_PAGE_ROWS
    max_bytes: int = MAX_PAGE_BYTES

    def capped(self, other: Limit) -> Limit:
        return Limit(min(self.max_records, other.max_records), min(self.max_bytes, other.max_bytes))

    @classmethod
    def page(cls, rows: int | None, cap: Limit | None = None) -> Limit:
        return cls(DEFAULT_PAGE_ROWS if rows is None else rows).capped(cap or cls())


@dataclass
class Page:
    """A page: its rows in order, why it ended, where the next one begins."""

    df: Any
    status: Status
    next: Cursor
    rows: int
    span: tuple[int, int] | None = None
    fingerprint: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)
