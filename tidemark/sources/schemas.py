"""Schemas of a log: canonical text, fingerprint, checks, and the way from Arrow."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import types as T

RESERVED = frozenset({"_partition", "_segment", "_chunk", "_index", "_bytes", "_topic", "_start", "_rank"})


class SchemaError(ValueError):
    """kind: BadTime, NullType, Reserved, EmptyBody, InvalidSchema or Unsupported."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind = kind


def canonical(schema: T.StructType, metadata: Mapping[str, str] | None = None) -> str:
    """One text for equal schemas: names, order, types, nullability, field and schema metadata."""
    return json.dumps({"schema": json.loads(schema.json()), "metadata": dict(sorted((metadata or {}).items()))}, sort_keys=True)


def fingerprint(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def parse(text: str) -> tuple[T.StructType, dict[str, str]]:
    d = json.loads(text)
    return T.StructType.fromJson(d["schema"]), d["metadata"]


def contains_null_type(t: T.DataType) -> bool:
    if isinstance(t, T.NullType):
        return True
    if isinstance(t, T.StructType):
        return any(contains_null_type(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return contains_null_type(t.elementType)
    if isinstance(t, T.MapType):
        return contains_null_type(t.keyType) or contains_null_type(t.valueType)
    return False


def check(schema: T.StructType) -> None:
    """The first column is a bigint named time; no null types, no reserved or repeated names."""
    if not schema.fields:
        raise SchemaError("EmptyBody", "no columns")
    if schema.names[0] != "time" or not isinstance(schema.fields[0].dataType, T.LongType):
        raise SchemaError("BadTime", "the first column must be time: bigint, in epoch milliseconds")
    if contains_null_type(schema):
        raise SchemaError("NullType")
    lower = [n.lower() for n in schema.names]
    if clash := RESERVED.intersection(lower):
        raise SchemaError("Reserved", ", ".join(sorted(clash)))
    if len(set(lower)) < len(lower):
        raise SchemaError("InvalidSchema", "repeated column names")


def normalise(table: pa.Table) -> pa.Table:
    """An Arrow table with the types that Spark can take: unsigned, half, small times, unions of storage."""

    def of(t: pa.DataType) -> pa.DataType:
        if isinstance(t, pa.BaseExtensionType):
            return of(t.storage_type)
        if pa.types.is_dictionary(t):
            return of(t.value_type)
        if pa.types.is_uint8(t):
            return pa.int16()
        if pa.types.is_uint16(t):
            return pa.int32()
        if pa.types.is_uint32(t):
            return pa.int64()
        if pa.types.is_uint64(t):
            return pa.decimal128(20, 0)
        if pa.types.is_float16(t):
            return pa.float32()
        if pa.types.is_date64(t):
            return pa.date32()
        if pa.types.is_time(t):
            return pa.time64("us")
        if pa.types.is_duration(t):
            return pa.duration("us")
        if pa.types.is_decimal256(t) and t.precision > 38:
            return pa.string()
        if pa.types.is_decimal256(t):
            return pa.decimal128(t.precision, t.scale)
        if pa.types.is_struct(t):
            return pa.struct([pa.field(f.name, of(f.type), f.nullable) for f in t])
        if pa.types.is_map(t):
            return pa.map_(of(t.key_type), of(t.item_type))
        if pa.types.is_fixed_size_list(t) or pa.types.is_list(t) or pa.types.is_large_list(t):
            return pa.list_(pa.field("element", of(t.value_type), t.value_field.nullable))
        return t

    def cast(col: pa.ChunkedArray, t: pa.DataType) -> pa.ChunkedArray:
        if isinstance(col.type, pa.BaseExtensionType):
            col = pa.chunked_array([c.storage for c in col.chunks], type=col.type.storage_type)
        if col.type == t:
            return col
        try:
            return col.cast(t)
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            return pa.chunked_array([pa.array(col.to_pylist(), type=t)])

    fields = [pa.field(f.name, of(f.type), f.nullable) for f in table.schema]
    return pa.Table.from_arrays([cast(table.column(i), f.type) for i, f in enumerate(fields)], schema=pa.schema(fields))
