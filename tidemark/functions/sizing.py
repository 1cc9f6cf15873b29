"""Byte sizes of values as column expressions, from the schema alone.

A fixed-width value counts its width even when null (as a column buffer does);
strings and binaries count their bytes, lists and maps the sum over their
elements. Everything stays inside Catalyst, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTHS: dict[type, int] = {
    T.BooleanType: 1, T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4,
    T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8, T.DayTimeIntervalType: 8, T.YearMonthIntervalType: 4,
}


def fixed_width(t: T.DataType) -> int | None:
    """Bytes of a value of a type whose values all have one size; else None."""
    if type(t) in WIDTHS:
        return WIDTHS[type(t)]
    if isinstance(t, T.DecimalType):
        return 8 if t.precision <= 18 else 16
    if isinstance(t, T.StructType):
        parts = [fixed_width(f.dataType) for f in t.fields]
        return None if None in parts else sum(parts)
    if t.typeName() == "time":
        return 8
    return None


def byte_size(col: Column, t: T.DataType) -> Column:
    """Bytes of ``col`` in each row, as a long."""
    width = fixed_width(t)
    if width is not None:
        return F.lit(width).cast("long")
    zero = F.lit(0).cast("long")
    if isinstance(t, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col).cast("long"), zero)
    if isinstance(t, T.ArrayType):
        inner = fixed_width(t.elementType)
        if inner is not None:
            return F.when(col.isNull(), zero).otherwise(F.size(col).cast("long") * inner)
        return F.coalesce(F.aggregate(col, zero, lambda a, x: a + byte_size(x, t.elementType)), zero)
    if isinstance(t, T.MapType):
        keys = byte_size(F.map_keys(col), T.ArrayType(t.keyType))
        values = byte_size(F.map_values(col), T.ArrayType(t.valueType))
        return F.when(col.isNull(), zero).otherwise(keys + values)
    if isinstance(t, T.StructType):
        total = zero
        for f in t.fields:
            total = total + byte_size(col.getField(f.name), f.dataType)
        return total
    raise TypeError(f"no byte size for {t.simpleString()}")


def row_size(schema: T.StructType, extra: int = 4) -> Column:
    """Bytes of a whole row and its index (``extra``)."""
    total = F.lit(extra).cast("long")
    for f in schema.fields:
        total = total + byte_size(F.col(f"`{f.name}`"), f.dataType)
    return total
