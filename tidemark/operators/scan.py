"""Ordered scans over a log as DataFrame functions.

A log has ``_partition`` (name), ``_index`` (position in the partition, from
0) and ``time`` (epoch milliseconds), besides the user's columns.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cursor import Cursor, InvalidQuery, Order, Status
from .selectors import partition_filter


def index_rows(df: DataFrame, partition: Column, order: Column, width: int = 1 << 16) -> DataFrame:
    """``df`` with ``_partition`` and ``_index``, the rank by ``order`` within the partition.

    ``order`` is an integer column, unique in its partition; rows without one come first. Ranges of it of
    ``width`` are ranked in parallel and offset by the running counts of the
    ranges, so that a partition of any size is many tasks: one aggregate, one
    small window over the counts, one window over (partition, range).
    """
    df = df.withColumn("_partition", partition.cast("string")).withColumn("_order", order.cast("long"))
    df = df.withColumn("_range", F.expr(f"_order div {width}") - F.when(F.col("_order") < 0, 1).otherwise(0))
    counts = df.groupBy("_partition", "_range").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("_partition").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    base = counts.select("_partition", "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    rank = F.row_number().over(W.partitionBy("_partition", "_range").orderBy("_order"))
    # a null partition or order has its place too
    base = base.withColumnsRenamed({"_partition": "_p", "_range": "_r"})
    ranked = df.withColumn("_rank", rank).join(base, F.col("_partition").eqNullSafe(F.col("_p")) & F.col("_range").eqNullSafe(F.col("_r"))).drop("_p", "_r")
    return ranked.withColumn("_index", (F.col("_base") + F.col("_rank") - 1).cast("long")).drop("_order", "_range", "_rank", "_base")


def spans(log: DataFrame) -> DataFrame:
    """(``_partition``, start, end): the half-open range of each partition's indices."""
    return log.groupBy("_partition").agg(F.min("_index").alias("start"), (F.max("_index") + 1).alias("end"))


def start_of(cursor: Mapping[str, int], default: Column) -> Column:
    """Each row's partition's position in the cursor, else ``default``."""
    if not cursor:
        return default
    pairs = F.create_map(*[F.lit(x) for kv in sorted(cursor.items()) for x in kv])
    return F.coalesce(pairs[F.col("_partition")].cast("long"), default)


def after(log: DataFrame, cursor: Mapping[str, int], order: Order = Order.FORWARD) -> DataFrame:
    """Rows at or after the cursor (forward), or before it (reverse: the cursor is exclusive).

    Partitions the cursor lacks start at their end. In reverse a cursor that
    has partitions limits the scan to those.
    """
    if order is Order.FORWARD:
        return log.withColumn("_start", start_of(cursor, F.lit(0).cast("long"))).where(F.col("_index") >= F.col("_start"))
    if cursor:
        log = log.where(F.col("_partition").isin(sorted(cursor)))
        return log.withColumn("_start", start_of(cursor, F.lit(0).cast("long"))).where(F.col("_index") < F.col("_start"))
    ends = spans(log).select("_partition", F.col("end").alias("_start"))
    return log.join(ends, "_partition")


def in_time(log: DataFrame, low: int, high: int, order: Order = Order.FORWARD) -> DataFrame:
    """Rows with a time in [low, high], in whatever order the times were stored."""
    if order is Order.REVERSE:
        raise InvalidQuery("a time range can't be read in reverse")
    return log.where(F.col("time").between(low, high))


def in_partitions(log: DataFrame, selectors: Sequence[str] | None) -> DataFrame:
    return log.where(partition_filter(log.sparkSession, selectors, F.col("_partition")))


def ordered(started: DataFrame, order: Order = Order.FORWARD) -> list[Column]:
    """Sort keys of a topic scan: partitions by (position, name), each drained before the next."""
    keys = [F.col("_start"), F.col("_partition"), F.col("_index")]
    return [k.desc() for k in keys] if order is Order.REVERSE else keys


def page(log: DataFrame, cursor: Mapping[str, int], limit: int, order: Order = Order.FORWARD) -> DataFrame:
    """The first ``limit`` rows after the cursor: a top-k (TakeOrderedAndProject), no full sort."""
    started = after(log, cursor, order)
    return started.orderBy(*ordered(started, order)).limit(limit)


def partition_page(log: DataFrame, partition: str, start: int, limit: int, order: Order = Order.FORWARD) -> DataFrame:
    one = log.where(F.col("_partition") == partition)
    if order is Order.REVERSE:
        return one.where(F.col("_index") < start).orderBy(F.col("_index").desc()).limit(limit)
    return one.where(F.col("_index") >= start).orderBy("_index").limit(limit)


def advance(rows: DataFrame, cursor: Mapping[str, int], known: DataFrame, order: Order = Order.FORWARD) -> DataFrame:
    """(``_partition``, next): the cursor after the rows of a page; ``known`` has _partition, start and end.

    A partition without rows in the page keeps its position.
    """
    forward = order is Order.FORWARD
    moved = rows.groupBy("_partition").agg((F.max("_index") + 1 if forward else F.min("_index")).alias("_to"))
    old = start_of(cursor, F.col("start") if forward else F.col("end"))
    return known.join(moved, "_partition", "left").select("_partition", F.coalesce("_to", old).alias("next"))


def status(rows: int, limit: int, any_matched: bool = True) -> Status:
    """RecordLimited as soon as the limit is reached, even if nothing is left."""
    return Status.RECORD_LIMITED if rows >= limit and any_matched else Status.ALL


def byte_limited(log: DataFrame, max_bytes: int, order: Sequence[str] = ("_start", "_partition", "_segment", "_chunk")) -> DataFrame:
    """Rows of the chunks before and including the one that reaches ``max_bytes``.

    ``log`` has ``_bytes`` for each row. The running sum goes over the chunk
    table only; the rows come back by a semi join on the chunk's key.
    """
    keys = list(order)
    # a row has 4 bytes at least, so that no more chunks than this can be needed
    chunks = log.groupBy(*keys).agg(F.sum("_bytes").alias("_b")).orderBy(*keys).limit(max_bytes // 4 + 1)
    before = F.coalesce(F.sum("_b").over(W.orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    kept = chunks.withColumn("_before", before).where(F.col("_before") < max_bytes)
    return log.join(kept.select(*keys), keys, "left_semi")


def segments(log: DataFrame, segment: Column) -> DataFrame:
    """One row a segment: its index range, time range, rows and bytes (if ``_bytes`` is there)."""
    aggs = [F.min("_index").alias("record_start"), (F.max("_index") + 1).alias("record_end"), F.min("time").alias("time_start"), F.max("time").alias("time_end"), F.count(F.lit(1)).alias("rows")]
    if "_bytes" in log.columns:
        aggs.append(F.sum("_bytes").alias("size"))
    return log.groupBy("_partition", segment.alias("_segment")).agg(*aggs)


def overlapping(manifest: DataFrame, low: int, high: int, start: int = 0) -> DataFrame:
    """Segments that can hold rows of the time range at or after ``start``."""
    return manifest.where((F.col("time_start") <= high) & (F.col("time_end") >= low) & (F.col("record_end") > start))


def next_cursor(rows: DataFrame, cursor: Cursor, known: DataFrame, order: Order = Order.FORWARD) -> Cursor:
    """``advance`` as a dict: one row a partition."""
    return {r["_partition"]: r["next"] for r in advance(rows, cursor, known, order).collect()}
