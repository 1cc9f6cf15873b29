"""Data focus: projection, flattening, exclusion and size limits of nested columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.sizing import byte_size

#: Columns of the log that a focus carries along.
LOG_COLUMNS = ("_partition", "_segment", "_chunk", "_index", "_rank", "_bytes")


class PathError(KeyError):
    """kind: Empty, KeyMissing or NotStruct; path: as far as it went."""

    def __init__(self, kind: str, path: Sequence[str] = ()):
        super().__init__(f"{kind}: {list(path)}")
        self.kind, self.path = kind, list(path)


@dataclass(frozen=True)
class DataFocus:
    """``dataset``: paths, ``*`` for all fields; ``separator`` splits paths and flattens structs to leaves.

    ``exclude`` names paths, structs or leaves to leave out; ``max_bytes``
    nulls a column in each chunk where it takes more bytes.
    """

    dataset: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    separator: str | None = None
    max_bytes: int | None = None

    @property
    def active(self) -> bool:
        return bool(self.dataset or self.exclude or self.separator or self.max_bytes is not None)


def ref(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def resolve(schema: T.StructType, path: Sequence[str]) -> tuple[Column, T.DataType]:
    """The column at a path through structs, and its type."""
    path = list(path)
    if not path:
        raise PathError("Empty")
    col, t = None, schema
    for k, name in enumerate(path):
        if not isinstance(t, T.StructType):
            raise PathError("NotStruct", path[:k])
        if name not in t.names:
            raise PathError("KeyMissing", path[: k + 1])
        col = ref(name) if col is None else col.getField(name)
        t = t[name].dataType
    return col, t


def tables(schema: T.StructType) -> list[list[str]]:
    """Paths of the nested structs, outer ones first."""
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.StructType):
            out.append([f.name])
            out += [[f.name, *p] for p in tables(f.dataType)]
    return out


def arrays(schema: T.StructType) -> list[list[str]]:
    """Paths of the leaves, depth first."""
    out = []
    for f in schema.fields:
        out += [[f.name, *p] for p in arrays(f.dataType)] if isinstance(f.dataType, T.StructType) else [[f.name]]
    return out


def get_table(df: DataFrame, path: Sequence[str]) -> DataFrame:
    """The struct at a path as a table of its fields."""
    col, t = resolve(df.schema, path)
    if not isinstance(t, T.StructType):
        raise PathError("NotStruct", path)
    return df.select(*[col.getField(n).alias(n) for n in t.names])


def from_struct(df: DataFrame, name: str) -> DataFrame:
    return get_table(df, [name])


def to_struct(df: DataFrame, name: str = "row") -> DataFrame:
    return df.select(F.struct(*[ref(c) for c in df.columns]).alias(name))


def plan(schema: T.StructType, focus: DataFocus) -> list[tuple[str, Column, T.DataType]]:
    """(name, column, type) of the focused columns, in order."""
    out: list[tuple[str, Column, T.DataType]] = []
    exclude, sep = set(focus.exclude), focus.separator

    def leaves(name: str, col: Column, t: T.DataType) -> None:
        if name in exclude:
            return
        if isinstance(t, T.StructType):
            for f in t.fields:
                leaves(name + sep + f.name, col.getField(f.name), f.dataType)
        else:
            out.append((name, col, t))

    paths = [p for d in focus.dataset for p in (schema.names if d == "*" else [d])]
    for path in paths:
        col, t = resolve(schema, path.split(sep) if sep else [path])
        if path in exclude:
            continue
        if sep:
            leaves(path, col, t)
        else:
            out.append((path, col, t))
    if not out:
        raise PathError("Empty")
    if len(out) == 1 and isinstance(out[0][2], T.StructType):  # one struct: its fields
        _, col, t = out[0]
        return [(f.name, col.getField(f.name), f.dataType) for f in t.fields]
    return out


def apply(df: DataFrame, focus: DataFocus, chunk: Sequence[str] = ("_partition", "_segment", "_chunk")) -> DataFrame:
    """``df`` focused; its log columns, if any, come along for ordering.

    Only a byte limit needs a shuffle: a window over (partition, segment,
    chunk), whose groups a chunk's size bounds.
    """
    if not focus.active:
        return df
    carried = [c for c in df.columns if c in LOG_COLUMNS]
    schema = T.StructType([f for f in df.schema.fields if f.name not in LOG_COLUMNS])
    # a single struct is unwrapped first: its fields are sized one by one
    columns = plan(schema, focus)
    if focus.max_bytes is not None:
        keys = [c for c in chunk if c in df.columns]
        over = W.partitionBy(*keys)
        columns = [(n, F.when(F.sum(byte_size(c, t)).over(over) <= focus.max_bytes, c), t) for n, c, t in columns]
    names = [n for n, *_ in columns]
    clash = {c: f"_{c}" for c in carried if c in names}
    return df.select(*[ref(c).alias(clash.get(c, c)) for c in carried], *[c.alias(n) for n, c, _ in columns])
