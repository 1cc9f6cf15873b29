"""The log store: append, scan, retain, compact and recover topics.

Layout: ``root/topics/<topic>/_log`` is the manifest; data files lie in
``root/topics/<topic>/<fingerprint>/<commit>/<partition hash>/<segment>/``, or
``<first>-<last>/`` where a bulk append puts small segments together
(``file_rows``); a partition's newest segment always has files of its own. Each
file holds ``_partition``, ``_segment``, ``_index``, ``_chunk`` and ``_bytes``
(of the row) besides the user's columns, so that scans and their budgets never need to count rows or
measure values again. A commit becomes visible with its manifest entry only;
what a lost writer left behind is an orphan, which ``recover`` removes.

Every append asks first whether the file system has room (``min_free_bytes``);
while it hasn't, the store is read-only and unhealthy. Retention runs once a
commit, over the partitions it touched. Mind that a partition keeps
``retain.max_bytes`` (1 GiB by default), a bulk append's own rows included:
set it to what the topic should keep.
"""

from __future__ import annotations

import hashlib
import posixpath
import time
import uuid
from collections import Counter, OrderedDict, deque
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from heapq import heapify, heappop

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from tidemark.functions.sizing import row_size
from tidemark.functions.timing import to_millis
from tidemark.operators import focus as focusing
from tidemark.operators.budget import ChunkStat, Fold, Piece, compaction, fold
from tidemark.operators.cursor import MAX_PAGE_BYTES, MAX_PAGE_ROWS, Cursor, InvalidQuery, Limit, Order, Page, Status
from tidemark.operators.selectors import select_names

from . import manifest as mf
from . import schemas
from .files import Files, decode, encode, join

PHYSICAL = [T.StructField("_partition", T.StringType()), T.StructField("_segment", T.LongType()), T.StructField("_index", T.LongType()), T.StructField("_chunk", T.LongType()), T.StructField("_bytes", T.LongType())]


CHUNK = ("chunk", "index_start", "rows", "bytes", "time_min", "time_max")
#: Segments whose stored chunks are remembered.
KNOWN_SEGMENTS = 1_000


@dataclass(frozen=True)
class Rolling:
    """A new segment begins once the open one is beyond any of these, or the schema changes."""

    max_rows: int = 100_000
    max_bytes: int = 100 << 20
    max_seconds: float | None = None


@dataclass(frozen=True)
class Retention:
    """What a partition keeps at most."""

    max_segments: int = 10_000
    max_bytes: int = 1 << 30
    max_age_ms: int | None = None


@dataclass(frozen=True)
class Config:
    roll: Rolling = field(default_factory=Rolling)
    retain: Retention = field(default_factory=Retention)
    #: of the whole store, for ``retain``
    max_total_bytes: int = 99 << 30
    max_append_bytes: int = 10_240_000
    max_page: Limit = field(default_factory=lambda: Limit(MAX_PAGE_ROWS, MAX_PAGE_BYTES))
    min_free_bytes: int = 1_000_000_000
    chunk_rows: int = 1000
    chunk_bytes: int = 1 << 20
    #: chunks of one append that stand in the manifest; those of a larger one stay in files
    inline_chunks: int = 256
    #: rows up to which neighbouring segments of a bulk append share their files
    file_rows: int = 100_000
    #: seconds for which a look at the free room holds
    check_disk_seconds: float = 1.0
    #: whether a topic's newest segments are checked when this store first uses it
    recover_on_open: bool = True
    #: appends of the service that may wait for a topic's writer, and for how many seconds one more tries to
    append_queue: int = 1
    append_wait_seconds: float = 0.1


class StoreError(RuntimeError):
    pass


class ReadOnlyError(StoreError):
    pass


class WriterBusy(StoreError):
    """An append found the queue of its topic full."""


class RequestTooLong(StoreError):
    def __init__(self, size: int, limit: int):
        super().__init__(f"{size} bytes; the limit is {limit}")
        self.size, self.limit = size, limit


def _among(col: Column, values: Iterable[int]) -> Column:
    """Whether a number is one of these: by their runs, or a hashed set where there are many."""
    own = sorted(values)
    starts = [x for k, x in enumerate(own) if not k or own[k - 1] != x - 1]
    if len(starts) > 16:
        return col.isin(own)
    ends = [x for k, x in enumerate(own) if k + 1 == len(own) or own[k + 1] != x + 1]
    return reduce(lambda a, b: a | b, [col.between(lo, hi) for lo, hi in zip(starts, ends)])


Data = DataFrame | pa.Table | pa.RecordBatch | pd.DataFrame | Sequence[Mapping]


@dataclass
class _Kept:
    """What the fold kept for a page."""

    topic: str
    state: mf.State
    starts: list[tuple[int, str]]
    order: Order
    span: tuple[int, int] | None
    got: Fold

    @property
    def rows(self) -> int:
        return sum(p.take for p in self.got.pieces)

    def keys(self) -> list[Column]:
        return [F.col("_rank"), F.col("_index").desc() if self.order is Order.REVERSE else F.col("_index")]

    def pieces(self) -> Iterator[tuple[Piece, int, int]]:
        """Each piece with its first and last index; a cut one ends where the next page begins."""
        for p in self.got.pieces:
            lo, hi = p.stat.first, p.stat.last
            if p is self.got.cut:
                at = self.got.next[p.stat.partition]
                lo, hi = (lo, at - 1) if self.order is Order.FORWARD else (at, hi)
            yield p, lo, hi

    def ranges(self) -> dict[str, tuple[int, int]]:
        out: dict[str, tuple[int, int]] = {}
        for p in self.got.pieces:
            lo, hi = out.get(p.stat.partition, (p.stat.first, p.stat.last))
            out[p.stat.partition] = min(lo, p.stat.first), max(hi, p.stat.last)
        if self.span is None and self.got.cut is not None and self.got.cut.take:
            name = self.got.cut.stat.partition
            (lo, hi), at = out[name], self.got.next[name]
            out[name] = (lo, at - 1) if self.order is Order.FORWARD else (at, hi)
        return out


class LogStore:
    def __init__(self, spark: SparkSession, root: str, config: Config | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or Config()
        self.files = Files(spark)
        self._manifests: dict[str, mf.Manifest] = {}
        self._known: OrderedDict[tuple[str, str, int, int, int], tuple[mf.Chunk, ...]] = OrderedDict()
        self.read_only = False
        self._checked = float("-inf")
        self.last_commit: float | None = None
        self.counters: Counter[tuple[str, str]] = Counter()

    # -- names -------------------------------------------------------------

    def _topic(self, topic: str) -> str:
        return join(self.root, "topics", encode(topic))

    def manifest(self, topic: str) -> mf.Manifest:
        if topic not in self._manifests:
            self._manifests[topic] = mf.Manifest(self.spark, self._topic(topic))
            if self.config.recover_on_open:
                self.rewind(topic)
        return self._manifests[topic]

    def topics(self) -> list[str]:
        return sorted(decode(n) for n in self.files.names(join(self.root, "topics")))

    def partitions(self, topic: str) -> dict[str, tuple[int, int]]:
        """The half-open index span of each partition."""
        state = self.manifest(topic).refresh()
        return {p: state.span(p) for p in state.partitions()}

    def size(self, topic: str | None = None, partition: str | None = None) -> int:
        """Bytes of rows kept: of the store, a topic or a partition."""
        names = self.topics() if topic is None else [topic]
        return sum(s.size for t in names for s in self.manifest(t).refresh().segments.values() if partition in (None, s.partition))

    def rows(self, topic: str) -> int:
        return sum(b - a for a, b in self.partitions(topic).values())

    def health(self) -> bool:
        """Whether the store takes appends. They are durable when they return, so there is no checkpoint to fall behind."""
        return self.check_disk()

    def metrics(self, topic: str) -> DataFrame:
        """Rows, bytes, segments, schemas and times of each partition."""
        kept = self.manifest(topic).df()
        return kept.groupBy("partition").agg(
            F.sum("rows").alias("rows"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("segments"), F.count_distinct("fingerprint").alias("schemas"),
            F.min("record_start").alias("record_start"), F.max("record_end").alias("record_end"), F.min("time_start").alias("time_start"), F.max("time_end").alias("time_end"),
        )

    def exposition(self) -> str:
        """Counters of this store object and gauges of its topics, in the text format that monitoring systems scrape."""
        lines = []
        quote = lambda x: x.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
        for name in sorted({n for _, n in self.counters}):
            lines.append(f"# TYPE tidemark_{name}_total counter")
            lines += [f'tidemark_{name}_total{{topic="{quote(t)}"}} {v}' for (t, n), v in sorted(self.counters.items()) if n == name]
        kept = {t: self.manifest(t).refresh().segments.values() for t in self.topics()}
        for name, value in (("segments", len), ("rows", lambda own: sum(s.rows for s in own)), ("bytes", lambda own: sum(s.size for s in own))):
            lines.append(f"# TYPE tidemark_{name} gauge")
            lines += [f'tidemark_{name}{{topic="{quote(t)}"}} {value(own)}' for t, own in kept.items()]
        lines += ["# TYPE tidemark_writable gauge", f"tidemark_writable {int(self.check_disk())}"]
        return "\n".join(lines) + "\n"

    def check_disk(self) -> bool:
        """Turn read-only while the store's file system has too little room."""
        fs, p = self.files._at(self.root)
        self.read_only = fs.getStatus(p if fs.exists(p) else None).getRemaining() < self.config.min_free_bytes
        self._checked = time.monotonic()
        return not self.read_only

    def _guard(self) -> None:
        """Before an append: an error while there is too little room."""
        if time.monotonic() - self._checked >= self.config.check_disk_seconds:
            self.check_disk()
        if self.read_only:
            raise ReadOnlyError("the store has too little room")

    # -- append ------------------------------------------------------------

    @staticmethod
    def arrow(data: Data) -> pa.Table:
        """Any accepted input but a DataFrame as an Arrow table."""
        if isinstance(data, pd.DataFrame):
            data = pa.Table.from_pandas(data, preserve_index=False).replace_schema_metadata(None)
        if isinstance(data, pa.RecordBatch):
            data = pa.Table.from_batches([data])
        if not isinstance(data, pa.Table):
            data = list(data)
            if not data:
                raise schemas.SchemaError("EmptyBody")
            data = pa.Table.from_pylist(data)
        for f in data.schema:
            if pa.types.is_null(f.type) or "null" in str(f.type).replace("not null", ""):
                raise schemas.SchemaError("NullType", f.name)
        return data

    def frame(self, data: Data) -> tuple[DataFrame, dict[str, str]]:
        """Any accepted input as a DataFrame, with its schema metadata."""
        if isinstance(data, DataFrame):
            return data, {}
        data = self.arrow(data)
        meta = {k.decode(): v.decode() for k, v in (data.schema.metadata or {}).items()}
        return self.spark.createDataFrame(schemas.normalise(data)), meta

    def append(self, topic: str, partition: str, data: Data, *, order_by: Sequence[str | Column] | None = None, metadata: Mapping[str, str] | None = None) -> tuple[int, int]:
        """Append rows as one chunk, in the order of ``order_by`` (else in input order). Returns their index span.

        Durable when it returns.
        """
        if not isinstance(data, DataFrame) and not order_by:
            return self._append_table(topic, partition, self.arrow(data), metadata or {})
        spans = self.append_all(topic, data, partition=F.lit(partition), order_by=order_by, metadata=metadata, chunk_rows=None)
        if not spans:
            raise schemas.SchemaError("EmptyBody", "no rows")
        return spans[partition]

    def _append_table(self, topic: str, partition: str, table: pa.Table, metadata: Mapping[str, str]) -> tuple[int, int]:
        """Append a table that the driver holds: its indices are known, so that one write job does it all."""
        self._guard()
        meta = {k.decode(): v.decode() for k, v in (table.schema.metadata or {}).items()} | dict(metadata)
        table = schemas.normalise(table)
        schema = T.StructType(from_arrow_schema(table.schema).fields)
        schemas.check(schema)
        if not table.num_rows:
            raise schemas.SchemaError("EmptyBody", "no rows")
        if table.column("time").null_count:
            raise schemas.SchemaError("BadTime", "null times")
        text = schemas.canonical(schema, meta)
        mark = schemas.fingerprint(text)
        state = self.manifest(topic).refresh()
        start, segment, chunk = self._place(state, mark, partition)
        n = table.num_rows
        indexed = table.append_column("_index", pa.array(range(start, start + n), pa.int64()))
        rows = self.spark.createDataFrame(indexed).select(
            F.lit(partition).alias("_partition"), F.lit(segment).cast("long").alias("_segment"), "_index", F.lit(chunk).cast("long").alias("_chunk"), row_size(schema).alias("_bytes"), *[focusing.ref(c) for c in schema.names]
        )
        seen = Observation()
        out = join(self._topic(topic), mark, uuid.uuid4().hex)
        rows = rows.coalesce(1).observe(seen, F.sum("_bytes").alias("b"), F.min("time").alias("lo"), F.max("time").alias("hi"))
        self._write(rows, out)
        got = seen.get
        chunks = {(partition, segment): [mf.Chunk(chunk, start, n, got["b"], got["lo"], got["hi"])]}
        self._publish(topic, mark, text, chunks, self._written(out, [partition]), {partition: start}, state.version)
        return start, start + n

    @staticmethod
    def _write(rows: DataFrame, out: str, folder: Column | None = None) -> None:
        """Write rows in the order of their indices, by partition and segment (or ``folder``)."""
        rows = rows.withColumn("_p", F.substring(F.sha2("_partition", 256), 1, 16)).withColumn("_s", F.col("_segment").cast("string") if folder is None else folder)
        rows.sortWithinPartitions("_p", "_s", "_index").write.partitionBy("_p", "_s").parquet(out)

    def _place(self, state: mf.State, mark: str, p: str) -> tuple[int, int, int]:
        """Where the next rows of a partition go: their index, segment and chunk."""
        own = state.of(p)
        last = own[-1] if own else None
        start = state.ends.get(p, 0)
        if last and not self._rolls(last, mark):
            return start, last.segment, last.last_chunk + 1
        # numbers go on above whatever retention has dropped
        return start, (last.segment + 1 if last else (state.version + 1) << 20 if start else 0), 0

    def _publish(self, topic: str, mark: str, text: str, chunks: dict, written: dict, start: dict[str, int], version: int, stored: dict | None = None) -> None:
        stored = stored or {}
        new_segments = new_schemas = 0

        def make(new: mf.State) -> dict:
            nonlocal new_segments, new_schemas
            if new.version != version and any(new.ends.get(p, 0) != at for p, at in start.items()):
                raise StoreError("another writer appended to the same partition")
            segs, new_segments, new_schemas = [], 0, 0
            for key in sorted(chunks.keys() | stored.keys()):
                old = new.segments.get(key)
                files, own, kept = written.get(key, ()), tuple(chunks.get(key, ())), tuple(stored.get(key, ()))
                new_segments += old is None
                segs.append(mf.with_files(old, files, own, kept) if old else mf.Segment(key[0], key[1], mark, files, own, time.time(), stored=kept))
            new_schemas = mark not in new.schemas
            return {"schemas": {mark: text}, **mf.pack(segs)}

        self.manifest(topic).commit(make)
        self.last_commit = time.time()
        self.counters[topic, "commits"] += 1
        self.counters[topic, "segments_created"] += new_segments
        self.counters[topic, "schemas_created"] += new_schemas
        parts = [*(c for own in chunks.values() for c in own), *(c for own in stored.values() for c in own)]
        self.counters[topic, "rows_written"] += sum(c.rows for c in parts)
        self.counters[topic, "bytes_written"] += sum(c.bytes for c in parts)
        self._retain_partitions(topic, start)

    def append_request(self, topic: str, partition: str, data: pa.Table) -> tuple[int, int]:
        """An append of limited size, as a remote client makes it."""
        if data.nbytes > self.config.max_append_bytes:
            raise RequestTooLong(data.nbytes, self.config.max_append_bytes)
        return self.append(topic, partition, data)

    def append_batches(self, topic: str, partition: str, data: pa.Table) -> list[tuple[int, int]]:
        """Append a table of any size by requests within the limit, halving the rows of those beyond it."""
        out, queue = [], [data]
        while queue:
            part = queue.pop(0)
            if part.nbytes > self.config.max_append_bytes and part.num_rows > 1:
                half = part.num_rows // 2
                queue[:0] = [part.slice(0, half).combine_chunks(), part.slice(half).combine_chunks()]
                continue
            out.append(self.append_request(topic, partition, part))
        return out

    def append_all(self, topic: str, data: Data, *, partition: str | Column, order_by: Sequence[str | Column] | None = None, metadata: Mapping[str, str] | None = None, chunk_rows: int | None = 1000, columns: Sequence[str] | None = None, schema_text: str | None = None) -> dict[str, tuple[int, int]]:
        """Append rows to many partitions at once, by a column; one commit for all.

        ``columns``: the columns to store (all by default); ``schema_text``: the
        canonical schema to store them under, as another store has it.

        Rows are range-partitioned by (partition, order) and sorted there, so
        a partition of any size is written by many tasks; a count of each
        task's rows of each partition gives the tasks their first index.
        """
        self._guard()
        df, meta = self.frame(data)
        meta |= metadata or {}
        cols = list(columns or df.columns)
        stored = T.StructType([df.schema[c] for c in cols])
        schemas.check(stored)
        text = schema_text or schemas.canonical(stored, meta)
        mark = schemas.fingerprint(text)
        commit = uuid.uuid4().hex
        staging = join(self._topic(topic), "_staging", commit)
        name = (F.col(partition) if isinstance(partition, str) else partition).cast("string")
        keys = [(focusing.ref(k) if isinstance(k, str) else k).alias(f"_k{i}") for i, k in enumerate(order_by or ())]
        staged = df.select(F.coalesce(name, F.lit("")).alias("_partition"), *[focusing.ref(c) for c in cols], row_size(stored).alias("_bytes"), *keys)
        if keys:
            by = [f"_k{i}" for i in range(len(keys))]
            staged = staged.repartitionByRange("_partition", *by).sortWithinPartitions("_partition", *by).drop(*by)
        # the place of a row: its task, and its position in the task's output
        staged = staged.withColumn("_place", F.monotonically_increasing_id())
        staged.write.parquet(staging)
        try:
            read = self.spark.read.parquet(staging)
            task = F.shiftright("_place", 33)
            counted = read.groupBy("_partition", task.alias("_task")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"), F.sum(F.col("time").isNull().cast("int")).alias("_null")).collect()
            if any(r["_null"] for r in counted):
                raise schemas.SchemaError("BadTime", "null times")
            if not counted:
                return {}
            return self._commit(topic, read, cols, counted, text, mark, commit, chunk_rows, bool(order_by))
        finally:
            self.files.delete(staging)

    def _commit(self, topic, read, cols, counted, text, mark, commit, chunk_rows, sorted_):
        task = F.shiftright("_place", 33)
        totals: dict[str, int] = {}
        base = []
        for r in sorted(counted, key=lambda r: (r["_partition"], r["_task"])):
            base.append((r["_partition"], r["_task"], totals.get(r["_partition"], 0)))
            totals[r["_partition"]] = totals.get(r["_partition"], 0) + r["_n"]
        offsets = self.spark.createDataFrame(base, "_partition string, _task long, _base long")
        if sorted_:  # rows of a partition lie together in their task
            first = self.spark.createDataFrame([(r["_partition"], r["_task"], r["_first"]) for r in counted], "_partition string, _task long, _first long")
            local = F.col("_place") - F.col("_first")
            placed = read.withColumn("_task", task).join(F.broadcast(offsets.join(first, ["_partition", "_task"])), ["_partition", "_task"])
        else:
            local = F.row_number().over(W.partitionBy("_partition", "_task").orderBy("_place")) - 1
            placed = read.withColumn("_task", task).join(F.broadcast(offsets), ["_partition", "_task"])
        placed = placed.withColumn("_local", F.col("_base") + local)

        state = self.manifest(topic).refresh()
        places = {p: self._place(state, mark, p) for p in totals}
        start = {p: at for p, (at, *_) in places.items()}
        rule = self.spark.createDataFrame([(p, *places[p], n) for p, n in totals.items()], "_partition string, _from long, _segment0 long, _chunk0 long, _total long")
        chunk = F.col("_chunk0") + (F.expr(f"_local div {chunk_rows}") if chunk_rows else F.lit(0))
        # a bulk append fills whole segments: chunk by chunk, max_rows each
        per = max(1, self.config.roll.max_rows // chunk_rows) if chunk_rows else None
        segment = F.col("_segment0") + (F.expr(f"(_local div {chunk_rows}) div {per}") if per else F.lit(0))
        folder = self._folder(per * chunk_rows) if per else F.col("_segment0").cast("string")
        rows = placed.join(F.broadcast(rule), "_partition").select(
            "_partition", segment.cast("long").alias("_segment"), (F.col("_from") + F.col("_local")).cast("long").alias("_index"), chunk.cast("long").alias("_chunk"), "_bytes", *[focusing.ref(c) for c in cols], folder.alias("_s")
        )
        out = join(self._topic(topic), mark, commit)
        self._write(rows, out, F.col("_s"))
        written = self._written(out, totals)
        again = self.spark.read.schema("_partition string, _segment long, _index long, _chunk long, _bytes long, time long").option("recursiveFileLookup", "true").parquet(out)
        stats = again.groupBy(F.col("_partition").alias("partition"), F.col("_segment").alias("segment"), F.col("_chunk").alias("chunk")).agg(
            F.min("_index").alias("index_start"), F.count(F.lit(1)).alias("rows"), F.sum("_bytes").alias("bytes"), F.min("time").alias("time_min"), F.max("time").alias("time_max")
        )
        chunks: dict[tuple[str, int], list[mf.Chunk]] = {}
        stored: dict[tuple[str, int], list[mf.Stored]] = {}
        if chunk_rows is None or sum(-(-n // chunk_rows) for n in totals.values()) <= self.config.inline_chunks:
            for r in sorted(stats.collect(), key=lambda r: r["index_start"]):
                chunks.setdefault((r["partition"], r["segment"]), []).append(mf.Chunk(*(r[c] for c in CHUNK)))
        else:  # the chunks stay in files; a row a segment comes here
            path = join(self._topic(topic), "_chunks", commit)
            stats.repartitionByRange("partition", "segment").sortWithinPartitions("partition", "segment", "chunk").write.parquet(path)
            sums = self._chunk_rows([path]).groupBy("partition", "segment").agg(
                F.max("chunk").alias("chunk"), F.min("index_start").alias("index_start"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.min("time_min").alias("time_min"), F.max("time_max").alias("time_max"), F.count(F.lit(1)).alias("n")
            )
            for batch in sums.toArrow().to_batches():
                for r in batch.to_pylist():
                    stored[r["partition"], r["segment"]] = [mf.Stored(path, *(r[c] for c in CHUNK), r["n"])]
        self._publish(topic, mark, text, chunks, written, start, state.version, stored)
        return {p: (start[p], start[p] + n) for p, n in totals.items()}

    def _folder(self, rows: int) -> Column:
        """The folder of a bulk append's row: as many whole segments of ``rows`` rows as ``file_rows`` allows, the partition's last one by itself."""
        many = max(1, self.config.file_rows // rows)
        own, last = F.expr(f"_local div {rows}"), F.expr(f"(_total - 1) div {rows}")
        first = F.when(own == last, last).otherwise(F.expr(f"_local div {rows * many} * {many}"))
        end = F.when(own == last, last).otherwise(F.least(first + many - 1, last - 1))
        name = lambda k: (F.col("_segment0") + k).cast("string")
        return F.when(first == end, name(first)).otherwise(F.concat(name(first), F.lit("-"), name(end)))

    def _chunk_rows(self, paths: Iterable[str]) -> DataFrame:
        return self.spark.read.schema("partition string, segment long, " + ", ".join(f"{c} long" for c in CHUNK)).parquet(*paths)

    def _chunks_of(self, topic: str, segs: Sequence[mf.Segment]) -> dict[int, tuple[mf.Chunk, ...]]:
        """The chunks of segments of one partition, by segment: from the manifest, or one read of the files that hold them."""
        out, want = {}, []
        for s in segs:
            key = topic, s.partition, s.segment, s.version, len(s.stored)
            if not s.stored:
                out[s.segment] = s.chunks
            elif key in self._known:
                self._known.move_to_end(key)
                out[s.segment] = tuple(sorted((*s.chunks, *self._known[key]), key=lambda c: c.index_start))
            else:
                want.append(s)
        if want:
            paths = sorted({c.path for s in want for c in s.stored})
            rows = self._chunk_rows(paths).where((F.col("partition") == want[0].partition) & F.col("segment").isin([s.segment for s in want]))
            found: dict[int, list[mf.Chunk]] = {}
            for r in rows.collect():
                found.setdefault(r["segment"], []).append(mf.Chunk(*(r[c] for c in CHUNK)))
            for s in want:
                own = tuple(found.get(s.segment, ()))
                self._known[topic, s.partition, s.segment, s.version, len(s.stored)] = own
                out[s.segment] = tuple(sorted((*s.chunks, *own), key=lambda c: c.index_start))
            while len(self._known) > KNOWN_SEGMENTS:
                self._known.popitem(last=False)
        return out

    def _written(self, out: str, partitions: Iterable[str]) -> dict[tuple[str, int], tuple[str, ...]]:
        """The data files of a commit by (partition, segment); folders are named by a hash of the partition and the segments in them."""
        names = {hashlib.sha256(p.encode()).hexdigest()[:16]: p for p in partitions}
        folders: dict[tuple[str, int, int], list[str]] = {}
        for path, _ in self.files.walk(out):
            if path.endswith(".parquet"):
                folders.setdefault((names[path.split("/")[-3].partition("=")[2]], *mf.held(path)), []).append(path)
        return {(p, n): files for (p, a, b), found in folders.items() for files in [tuple(found)] for n in range(a, b + 1)}

    def _rolls(self, s: mf.Segment, mark: str) -> bool:
        r = self.config.roll
        return s.fingerprint != mark or s.rows > r.max_rows or s.size > r.max_bytes or (r.max_seconds is not None and time.time() - s.created > r.max_seconds)

    # -- read --------------------------------------------------------------

    def _read(self, topic: str, segments: Iterable[mf.Segment], state: mf.State) -> DataFrame | None:
        """Rows of segments of one schema, with _partition and _segment; their files only.

        Files that hold other segments as well, or rows that a segment no
        longer has there, are read by themselves and filtered.
        """
        segments = list(segments)
        if not segments:
            return None
        schema, _ = schemas.parse(state.schemas[segments[0].fingerprint])
        full = T.StructType([*PHYSICAL, *schema.fields])
        read = lambda paths: self.spark.read.schema(full).option("recursiveFileLookup", "true").parquet(*paths)
        wanted: dict[str, tuple[str, set[int]]] = {}
        for s in segments:
            for f in s.files:
                wanted.setdefault(f, (s.partition, set()))[1].add(s.segment)
        held = {f: mf.held(f) for f in wanted}
        whole = [f for f, (a, b) in held.items() if len(wanted[f][1]) == b - a + 1]
        # of the others, those whose segments overlap are kept apart: a segment may have moved from one to another
        layers: list[dict[str, tuple[str, set[int]]]] = []
        ends: list[dict[str, tuple[int, str]]] = []
        for f in sorted(held.keys() - set(whole), key=lambda f: (*held[f], f)):
            p, own = wanted[f]
            at = next((k for k, e in enumerate(ends) if p not in e or e[p][0] < held[f][0] or e[p][1] == posixpath.dirname(f)), len(layers))
            if at == len(layers):
                layers.append({})
                ends.append({})
            layers[at][f], ends[at][p] = (p, own), (held[f][1], posixpath.dirname(f))
        parts = [read(whole)] if whole else []
        for layer in layers:
            by: dict[str, set[int]] = {}
            for p, own in layer.values():
                by.setdefault(p, set()).update(own)
            parts.append(read(list(layer)).where(reduce(lambda a, b: a | b, [(F.col("_partition") == p) & _among(F.col("_segment"), own) for p, own in sorted(by.items())])))
        return reduce(DataFrame.unionAll, parts)

    def table(self, topic: str, fingerprint: str | None = None, partitions: Sequence[str] | None = None) -> DataFrame:
        """A topic as an ordinary DataFrame: all rows of one schema (the newest by default), in no order."""
        state = self.manifest(topic).refresh()
        names = set(select_names(self.spark, partitions, state.partitions()))
        segs = sorted((s for s in state.segments.values() if s.partition in names), key=lambda s: s.created)
        if not state.schemas:
            raise StoreError(f"topic {topic!r} has no rows")
        mark = fingerprint or (segs[-1].fingerprint if segs else list(state.schemas)[-1])
        rows = self._read(topic, [s for s in segs if s.fingerprint == mark], state)
        if rows is None:  # all of them were dropped
            rows = self.spark.createDataFrame([], T.StructType([*PHYSICAL, *schemas.parse(state.schemas[mark])[0].fields]))
        return rows

    def register(self, topic: str, view: str | None = None) -> None:
        """Make the topic a SQL view."""
        self.table(topic).createOrReplaceTempView(view or topic)

    def schemas(self, topic: str) -> dict[str, T.StructType]:
        return {k: schemas.parse(v)[0] for k, v in self.manifest(topic).refresh().schemas.items()}

    def _stats(self, topic: str, state: mf.State, segs: list[mf.Segment], where: Column | None) -> dict[tuple[int, int], ChunkStat]:
        """Chunk statistics of the matching rows of a partition's segments: one job, on three narrow columns and the time."""
        out = {}
        for mark in dict.fromkeys(s.fingerprint for s in segs):
            rows = self._read(topic, [s for s in segs if s.fingerprint == mark], state)
            rows = rows if where is None else rows.where(where)
            for r in rows.groupBy("_partition", "_segment", "_chunk").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b"), F.min("_index").alias("i"), F.max("_index").alias("j")).collect():
                out[r["_segment"], r["_chunk"]] = ChunkStat(r["_partition"], r["_segment"], r["_chunk"], mark, r["n"], r["b"], r["i"], r["j"])
        return out

    def _chunks(self, topic: str, state: mf.State, partition: str, start: int, order: Order, span: tuple[int, int] | None, exact: bool = True) -> Iterator[ChunkStat]:
        """Statistics of a partition's matching chunks in scan order, computed as far as they are asked for.

        Unless ``exact``, a chunk that the cursor is in counts all its bytes.
        """
        reverse = order is Order.REVERSE
        own = state.of(partition)
        step = 8
        if span is not None:
            segs = mf.by_time(own, *span, start)
            where = F.col("time").between(*span) & (F.col("_index") >= start)
            while segs:  # ever larger runs of segments: a page mostly ends within the first
                now, segs = segs[:step], segs[step:]
                step *= 2
                found = self._stats(topic, state, now, where)
                for key in sorted(found):
                    yield found[key]
            return
        segs = mf.by_index(own, start, reverse)
        while segs:
            now, segs = segs[:step], segs[step:]
            step *= 2
            known = self._chunks_of(topic, now)
            for s in now:
                for c in reversed(known[s.segment]) if reverse else known[s.segment]:
                    first, end = c.index_start, c.index_start + c.rows
                    if (end <= start) if not reverse else (first >= start):
                        continue
                    if first < start < end and not exact:
                        a, b = (start, end) if not reverse else (first, start)
                        yield ChunkStat(partition, s.segment, c.chunk, s.fingerprint, b - a, c.bytes, a, b - 1)
                    elif first < start < end:  # the cursor is inside: only that chunk is measured
                        inside = F.col("_index").between(start, end - 1) if not reverse else F.col("_index").between(first, start - 1)
                        yield self._stats(topic, state, [s], inside)[s.segment, c.chunk]
                    else:
                        yield ChunkStat(partition, s.segment, c.chunk, s.fingerprint, c.rows, c.bytes, first, end - 1)

    def iterate(
        self,
        topic: str,
        cursor: Mapping[str, int] | None = None,
        *,
        page_size: int | None = None,
        page_bytes: int | None = None,
        order: Order | str | None = None,
        time_start=None,
        time_end=None,
        partitions: Sequence[str] | None = None,
        focus: focusing.DataFocus | None = None,
        limit: Limit | None = None,
    ) -> Page:
        """The next page of a topic after ``cursor``."""
        state = self.manifest(topic).refresh()
        return self._page(self._next(topic, state, cursor, page_size=page_size, page_bytes=page_bytes, order=order, time_start=time_start, time_end=time_end, partitions=partitions, limit=limit), focus)

    def _next(self, topic: str, state: mf.State, cursor: Mapping[str, int] | None, *, page_size=None, page_bytes=None, order=None, time_start=None, time_end=None, partitions=None, limit=None) -> _Kept:
        order = Order.parse(order)
        cursor = dict(cursor or {})
        limit = limit or Limit.page(page_size, self.config.max_page)
        if page_bytes is not None:
            limit = limit.capped(Limit(limit.max_records, page_bytes))
        span = self._span(time_start, time_end, order)
        if order is Order.REVERSE and cursor:
            starts = [(at, p) for p, at in cursor.items()]
        else:
            starts = []
            for p in select_names(self.spark, partitions, state.partitions()):
                first, end = state.span(p)
                starts.append((cursor.setdefault(p, end if order is Order.REVERSE else first), p))
        starts.sort(reverse=order is Order.REVERSE)
        return self._keep(topic, state, starts, cursor, limit, order, span)

    def records(self, topic: str, partition: str, start: int, *, page_size: int | None = None, order: Order | str | None = None, time_start=None, time_end=None, focus: focusing.DataFocus | None = None, limit: Limit | None = None) -> Page:
        """A page of one partition from ``start`` (reverse: before it)."""
        order = Order.parse(order)
        span = self._span(time_start, time_end, order)
        state = self.manifest(topic).refresh()
        return self._page(self._keep(topic, state, [(start, partition)], {partition: start}, limit or Limit.page(page_size, self.config.max_page), order, span), focus)

    @staticmethod
    def _span(time_start, time_end, order: Order) -> tuple[int, int] | None:
        if time_start is None:
            return None
        if time_end is None:
            raise InvalidQuery("time_start needs time_end")
        if order is Order.REVERSE:
            raise InvalidQuery("a time range can't be read in reverse")
        return to_millis(time_start), to_millis(time_end)

    def _keep(self, topic, state, starts, cursor, limit, order, span) -> _Kept:
        """The chunks of a page and where the next one begins; no job but for statistics that the manifest lacks."""
        got = fold(starts, lambda p, at: self._chunks(topic, state, p, at, order, span, False), limit, order, cursor)
        if span is None and sum(p.stat.bytes for p in got.pieces) >= limit.max_bytes:  # whether the bytes are used up takes a measure
            got = fold(starts, lambda p, at: self._chunks(topic, state, p, at, order, span), limit, order, cursor)
        kept = _Kept(topic, state, starts, order, span, got)
        if got.cut is not None and got.cut.take:  # the page ends inside a chunk: its last row says where
            c = got.cut.stat
            if span is None:
                got.next[c.partition] = c.first + got.cut.take if order is Order.FORWARD else c.last + 1 - got.cut.take
            else:
                edge = self._kept_rows(kept).where(F.col("_partition") == c.partition).agg((F.max("_index") + 1).alias("x")).first()["x"]
                if edge is not None:
                    got.next[c.partition] = edge
        return kept

    def _kept_rows(self, kept: _Kept) -> DataFrame:
        """The rows of a page, in no order, with their partition's rank."""
        got, span = kept.got, kept.span
        segs = dict.fromkeys((p.stat.partition, p.stat.segment) for p in got.pieces)
        rows = self._read(kept.topic, [kept.state.segments[k] for k in segs], kept.state)
        # the kept ranges: at most one (first, last) a partition, as a scan drains it in order
        ranges = kept.ranges()
        keep = reduce(lambda a, b: a | b, [(F.col("_partition") == p) & F.col("_index").between(lo, hi) for p, (lo, hi) in sorted(ranges.items())])
        rank = {p: k for k, (_, p) in enumerate(kept.starts)}
        at = F.create_map(*[F.lit(x) for p in ranges for x in (p, rank[p])])
        rows = rows.where(keep).withColumn("_rank", at[F.col("_partition")])
        if span is not None:
            position = {p: at for at, p in kept.starts}
            rows = rows.where(F.col("time").between(*span) & (F.col("_index") >= F.create_map(*[F.lit(x) for p in ranges for x in (p, position[p])])[F.col("_partition")].cast("long")))
        return rows.orderBy(*kept.keys()).limit(kept.rows)

    def _page(self, kept: _Kept, focus: focusing.DataFocus | None) -> Page:
        got = kept.got
        if not kept.rows:
            empty = self.spark.createDataFrame([], T.StructType([]))
            return Page(empty, got.status, got.next, 0, None, got.fingerprint)
        _, meta = schemas.parse(kept.state.schemas[got.fingerprint])
        rows = self._kept_rows(kept)
        page_span = None
        if len(kept.starts) == 1 and kept.span is None:
            ((lo, hi),) = kept.ranges().values()
            page_span = lo, hi + 1
        elif len(kept.starts) == 1:
            edges = rows.agg(F.min("_index").alias("a"), (F.max("_index") + 1).alias("b")).first()
            page_span = (edges["a"], edges["b"])
        if focus is not None and focus.active:
            rows = focusing.apply(rows, focus)
        out = rows.orderBy(*kept.keys()).drop(*[c for c in focusing.LOG_COLUMNS if c in rows.columns])
        return Page(out, got.status, got.next, kept.rows, page_span, got.fingerprint, meta)

    def pages(self, topic: str, **query) -> Iterator[Page]:
        """Pages until the end of the data or a schema change that stops the scan."""
        cursor: Cursor | None = query.pop("cursor", None)
        while True:
            page = self.iterate(topic, cursor, **query)
            if page.rows:
                yield page
            if page.rows == 0 or page.status in (Status.ALL, Status.SCHEMA_CHANGE):
                return
            cursor = page.next

    def stack(self, topic: str, *, cursor: Mapping[str, int] | None = None, focus: focusing.DataFocus | None = None, **query) -> DataFrame | None:
        """The rows of all pages up to the end or a schema change as one DataFrame, in page order; None without rows.

        The pages are of the topic as it is now, and are read together: each
        chunk's rows meet the pages that it is in. (A union of pages, each a
        top-k in one task, would be one task in all.)
        """
        state = self.manifest(topic).refresh()
        state = replace(state, segments=dict(state.segments), schemas=dict(state.schemas), ends=dict(state.ends))
        runs: list[list[_Kept]] = []  # neighbouring pages of one schema
        while True:
            kept = self._next(topic, state, cursor, **query)
            if kept.rows:
                if not runs or runs[-1][-1].got.fingerprint != kept.got.fingerprint:
                    runs.append([])
                runs[-1].append(kept)
            if not kept.rows or kept.got.status in (Status.ALL, Status.SCHEMA_CHANGE):
                break
            cursor = kept.got.next
        parts, rank = [], 0
        for run in runs:
            pieces = []
            for kept in run:
                pieces += [(c.partition, c.segment, c.chunk, lo, hi, rank + p.rank) for p, lo, hi in kept.pieces() for c in [p.stat]]
                rank += len(kept.starts)
            parts.append(self._stacked(run[-1], pieces, focus))
        if not parts:
            return None
        rows = reduce(DataFrame.unionAll, parts)
        return rows.orderBy(*run[-1].keys()).drop("_rank", "_index")

    def _stacked(self, kept: _Kept, pieces: list[tuple], focus: focusing.DataFocus | None) -> DataFrame:
        """The rows of pieces (partition, segment, chunk, first, last, rank), focused page by page, with _rank and _index."""
        names = ["_partition", "_segment", "_chunk", "_lo", "_hi", "_rank"]
        table = self.spark.createDataFrame(pa.table({n: pa.array(x, pa.string() if n == "_partition" else pa.int64()) for n, x in zip(names, zip(*pieces))}))
        segs = dict.fromkeys((p, n) for p, n, *_ in pieces)
        rows = self._read(kept.topic, [kept.state.segments[k] for k in segs], kept.state)
        if kept.span is not None:
            rows = rows.where(F.col("time").between(*kept.span))
        mine = rows.columns
        rows = rows.join(F.broadcast(table), names[:3]).where(F.col("_index").between(F.col("_lo"), F.col("_hi"))).select("_rank", *[focusing.ref(c) for c in mine])
        if focus is not None and focus.active:
            rows = focusing.apply(rows, focus, ("_partition", "_segment", "_chunk", "_rank"))
        return rows.select("_rank", "_index", *[focusing.ref(c) for c in rows.columns if c not in focusing.LOG_COLUMNS])

    def by_index(self, topic: str, partition: str, index: int) -> DataFrame:
        state = self.manifest(topic).refresh()
        segs = [s for s in state.of(partition) if s.record_start <= index < s.record_end]
        if not segs:
            raise StoreError(f"no row {index}")
        return self._read(topic, segs, state).where(F.col("_index") == index)

    # -- upkeep ------------------------------------------------------------

    def _drop(self, topic: str, gone: list[mf.Segment]) -> None:
        if not gone:
            return
        self.manifest(topic).commit(lambda _: {"removed": [(s.partition, s.segment) for s in gone]})
        self.counters[topic, "segments_destroyed"] += len(gone)
        self.counters[topic, "bytes_destroyed"] += sum(s.size for s in gone)
        left = self.manifest(topic).refresh().segments.values()
        for f in {f for s in gone for f in s.files} - {f for s in left for f in s.files}:
            self.files.delete(f)
        for path in {c.path for s in gone for c in s.stored} - {c.path for s in left for c in s.stored}:
            self.files.delete(path)

    def _retain_partitions(self, topic: str, partitions: Iterable[str]) -> None:
        """Drop what these partitions hold beyond their bounds, the oldest first, in one commit."""
        by: dict[str, list[mf.Segment]] = {p: [] for p in partitions}
        for s in self.manifest(topic).refresh().segments.values():
            if s.partition in by:
                by[s.partition].append(s)
        gone = []
        r, now = self.config.retain, time.time() * 1000
        for own in by.values():
            own.sort(key=lambda s: s.segment)
            total = sum(s.size for s in own)
            for s in own[:-1]:  # the open segment always stays
                if not (total > r.max_bytes or own[-1].segment - s.segment + 1 > r.max_segments or (r.max_age_ms is not None and s.time_end < now - r.max_age_ms)):
                    break
                total -= s.size
                gone.append(s)
        self._drop(topic, gone)

    def retain(self) -> int:
        """Bring the store under its budget: as long as it is over, the partition of the oldest segment loses its first one."""
        states = {t: self.manifest(t).refresh() for t in self.topics()}
        alive: dict[tuple[str, str], deque[mf.Segment]] = {}
        for t, state in states.items():
            for s in sorted(state.segments.values(), key=lambda s: s.segment):
                alive.setdefault((t, s.partition), deque()).append(s)
        oldest = [(s.time_start, t, p, s.segment) for (t, p), own in alive.items() for s in own]
        heapify(oldest)
        total = sum(s.size for own in alive.values() for s in own)
        gone: dict[str, list[mf.Segment]] = {}
        while total > self.config.max_total_bytes and oldest:
            _, t, p, n = oldest[0]
            if not alive[t, p] or n < alive[t, p][0].segment:  # it went before as the first of its partition
                heappop(oldest)
                continue
            first = alive[t, p].popleft()
            gone.setdefault(t, []).append(first)
            total -= first.size
        for t, segs in gone.items():
            self._drop(t, segs)
        return sum(map(len, gone.values()))

    def compact(self, topic: str, partition: str) -> None:
        """Merge small chunks and files of each segment by the greedy rule, in one commit a segment."""
        state = self.manifest(topic).refresh()
        users = Counter(f for s in state.segments.values() for f in s.files)
        for s in state.of(partition):
            had = self._chunks_of(topic, [s])[s.segment]
            number = list(compaction([(c.rows, c.bytes) for c in had], self.config.chunk_rows, self.config.chunk_bytes))
            if len(set(number)) == len(had) and len(s.files) <= 1:
                continue
            new: list[mf.Chunk] = []
            for k, c in zip(number, had):
                if new and new[-1].chunk == k:
                    o = new[-1]
                    new[-1] = mf.Chunk(k, o.index_start, o.rows + c.rows, o.bytes + c.bytes, min(o.time_min, c.time_min), max(o.time_max, c.time_max))
                else:
                    new.append(mf.Chunk(k, c.index_start, c.rows, c.bytes, c.time_min, c.time_max))
            # chunks are merged whole: a row's new one follows from its old one, by one look-up however many there are
            moved = self.spark.createDataFrame(pa.table({"_old": pa.array([c.chunk for c in had], pa.int64()), "_new": pa.array(number, pa.int64())}))
            rows = self._read(topic, [s], state)
            columns = [F.col("_new").alias("_chunk") if c == "_chunk" else focusing.ref(c) for c in rows.columns]
            rows = rows.join(F.broadcast(moved), F.col("_chunk") == F.col("_old")).select(*columns)
            out = join(self._topic(topic), s.fingerprint, uuid.uuid4().hex)
            self._write(rows.repartitionByRange(max(1, s.size // (64 << 20)), "_index"), out)
            files = self._written(out, [s.partition])[s.partition, s.segment]

            def make(new_state: mf.State, s=s, files=files, new=new) -> dict:
                if new_state.segments.get((s.partition, s.segment)) != s:
                    raise StoreError("the segment changed while it was compacted")
                return mf.pack([replace(s, files=files, chunks=tuple(new), stored=(), version=s.version + 1)])

            self.manifest(topic).commit(make)
            users.subtract(s.files)
            for f in s.files:
                if not users[f]:  # no other segment has rows there
                    self.files.delete(f)

    def recover(self, topic: str) -> dict[str, int]:
        """Remove files no manifest row names, and rewind past newest segments that can't be read."""
        self._manifests.setdefault(topic, mf.Manifest(self.spark, self._topic(topic)))
        gone = self.rewind(topic, read=True)
        state = self.manifest(topic).refresh()
        files = {f for s in state.segments.values() for f in s.files}
        for f in {f for s in gone for f in s.files} - files:
            self.files.delete(f)
        # chunk files lie in a folder of their commit's name
        commits = {posixpath.basename(c.path) for s in state.segments.values() for c in s.stored}
        orphans = [f for f, _ in self.files.walk(self._topic(topic)) if f.endswith(".parquet") and f not in files and posixpath.basename(posixpath.dirname(f)) not in commits]
        for f in orphans:
            self.files.delete(f)
        return {"orphans": len(orphans), "segments": len(gone)}

    def rewind(self, topic: str, read: bool = False) -> list[mf.Segment]:
        """Leave out newest segments whose files are missing (with ``read``: or don't give their rows); the next index follows the last good one.

        Without ``read`` only the newest segment of each partition is looked
        at, by name; it goes on to older ones where that is bad.
        """
        state = self._manifests[topic].refresh()
        by: dict[str, list[mf.Segment]] = {}
        for s in sorted(state.segments.values(), key=lambda s: s.segment):
            by.setdefault(s.partition, []).append(s)
        gone: list[mf.Segment] = []
        check = [own[-1] for own in by.values()]
        while check:
            good = self._readable(topic, check, state) if read else {(s.partition, s.segment) for s in check if all(map(self.files.exists, s.files))}
            bad = [s for s in check if (s.partition, s.segment) not in good]
            gone += bad
            check = [s for b in bad if (own := by[b.partition]) and own.pop() and own for s in [own[-1]]]
        if gone:
            left = {p: (own[-1].record_end if own else min(s.record_start for s in gone if s.partition == p)) for p, own in by.items() if any(s.partition == p for s in gone)}
            self._manifests[topic].commit(lambda _: {"removed": [(s.partition, s.segment) for s in gone], "ends": left})
            self.counters[topic, "segments_rewound"] += len(gone)
        return gone

    def _readable(self, topic: str, segs: list[mf.Segment], state: mf.State) -> set[tuple[str, int]]:
        """Those of the segments whose files give all their rows: one job for all, or halves where it fails."""
        here = [s for s in segs if all(map(self.files.exists, s.files))]
        good: set[tuple[str, int]] = set()
        todo = [[s for s in here if s.fingerprint == mark] for mark in dict.fromkeys(s.fingerprint for s in here)]
        while todo:
            part = todo.pop()
            try:
                sums = self._read(topic, part, state).groupBy("_partition", "_segment").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()
            except Exception:  # noqa: BLE001 - Spark reports a broken file in many ways
                if len(part) > 1:
                    todo += [part[: len(part) // 2], part[len(part) // 2 :]]
                continue
            got = {(r["_partition"], r["_segment"]): (r["n"], r["b"]) for r in sums}
            good |= {(s.partition, s.segment) for s in part if got.get((s.partition, s.segment)) == (s.rows, s.size)}
        return good
