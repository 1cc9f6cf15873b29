"""Helpers shared by the corpus operators."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_columns(df: DataFrame, fields: list[T.StructField], compute: Callable[[pa.RecordBatch], list]) -> DataFrame:
    """Append the columns that ``compute`` makes of each Arrow batch.

    An input column that has the name of an output column (whatever its case)
    is replaced. ``compute`` returns one Arrow array or list for each field.
    """
    out = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in out]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]
    types = [to_arrow(f.dataType) for f in fields]
    made = [f.name for f in fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = compute(b)
            arrays = [b.column(b.schema.get_field_index(n)) for n in names]
            arrays += [c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == t else pa.array(c, type=t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(arrays, names=names + made)

    return df.mapInArrow(run, schema)


def to_arrow(t: T.DataType) -> pa.DataType:
    simple = {
        T.StringType: pa.string(), T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.DoubleType: pa.float64(),
        T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.BinaryType: pa.binary(), T.ShortType: pa.int16(),
    }
    if type(t) in simple:
        return simple[type(t)]
    if isinstance(t, T.ArrayType):
        return pa.list_(to_arrow(t.elementType))
    if isinstance(t, T.StructType):
        return pa.struct([pa.field(f.name, to_arrow(f.dataType)) for f in t.fields])
    raise TypeError(f"no Arrow type for {t}")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is absent one is made and set, in local mode (tests)
    only: a folder of one machine isn't shared by the executors of a cluster.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return posixpath.join(base, uuid.uuid4().hex)


def cut(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there."""
    df = df if columns is None else df.select(*columns)
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def discard(*cuts: DataFrame) -> None:
    """Delete what ``cut`` wrote, once nothing will read it again."""
    for df in cuts:
        if path := getattr(df, "_cut_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def held_out(doc_id: str = "doc_id"):
    """crc32 of the id as text is a multiple of 5 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))
