"""Formats of replies and of clients: Arrow IPC files, pandas records, and what to send when."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cursor import InvalidQuery, Page
from tidemark.operators.focus import PathError

from .schemas import SchemaError
from .store import ReadOnlyError, RequestTooLong, WriterBusy

ARROW = "application/vnd.apache.arrow.file"
JSON = "application/json"
RECORDS = "application/json; format=pandas-records"


class CannotEmit(ValueError):
    pass


def records_json(df: DataFrame) -> DataFrame:
    """Each row as a JSON object, nulls included."""
    return df.select(F.to_json(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]), {"ignoreNullFields": "false"}).alias("record"))


def negotiate(accept: str | None) -> str:
    """JSON unless Arrow is asked for; anything else can't be emitted."""
    if accept is None or accept.split(";")[0].strip() in ("", "*/*", JSON):
        return JSON
    if accept.split(";")[0].strip() == ARROW:
        return ARROW
    raise CannotEmit(accept)


def arrow_file(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_arrow_file(data: bytes) -> pa.Table:
    """The rows of an Arrow IPC file, whose batches share one schema by its format."""
    try:
        table = pa.ipc.open_file(data).read_all()
    except pa.ArrowInvalid as e:
        raise SchemaError("InvalidSchema", str(e)) from None
    if not table.num_rows:
        raise SchemaError("EmptyBody")
    return table


def page_table(page: Page) -> pa.Table:
    """A page as an Arrow table; its schema metadata has the status, the next cursor and the span."""
    table = page.df.toArrow() if page.df.columns else pa.table({})
    meta = page.metadata | {"status": json.dumps({"status": page.status.value, "next": page.next})}
    if page.span:
        meta["span"] = json.dumps({"start": page.span[0], "end": page.span[1]})
    return table.replace_schema_metadata(meta)


def reply(page: Page, accept: str | None = None) -> tuple[str, bytes]:
    """(content type, body) of a page."""
    kind = negotiate(accept)
    if kind == ARROW:
        return ARROW, arrow_file(page_table(page))
    if not page.df.columns:
        return RECORDS, b"[]"
    return RECORDS, ("[" + ",".join(r["record"] for r in records_json(page.df).collect()) + "]").encode()


def status_code(error: Exception) -> int:
    """The HTTP status of an error."""
    if isinstance(error, RequestTooLong):
        return 413
    if isinstance(error, CannotEmit):
        return 406
    if isinstance(error, (InvalidQuery, PathError, SchemaError)):
        return 400
    if isinstance(error, (ReadOnlyError, WriterBusy)):
        return 429
    return 500
