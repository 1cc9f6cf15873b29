"""A streaming source that tails a topic.

``spark.dataSource.register(TailSource)``, then
``spark.readStream.format("tidemark").option("root", ...).option("topic", ...).load()``.
The offset is the cursor: the next index of each partition, so that a query
resumes where its checkpoint stopped and finds partitions created since.
Options: ``partition.<n>`` names partitions (all by default), ``max_rows``
bounds the rows of a partition in a batch, ``starting`` is ``earliest`` or
``latest``. All rows of a stream have one schema: the newest at ``load``;
segments of another schema stop the query with an error rather than being
skipped.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidemark.sources import manifest as mf
from tidemark.sources import schemas
from tidemark.sources.files import encode, join

EXTRA = [T.StructField("_partition", T.StringType()), T.StructField("_index", T.LongType())]


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def read_state(root: str, topic: str) -> mf.State:
    """The manifest's state without a JVM."""
    at, base = open_path(join(root, "topics", encode(topic), "_log"))
    found = at.get_file_info(fs.FileSelector(base, allow_not_found=True))
    names = {f.base_name: f.path for f in found}
    state = mf.State()

    def load(path: str) -> dict:
        with at.open_input_stream(path) as f:
            return json.loads(f.read())

    snaps = sorted(int(n[:-9]) for n in names if n.endswith(".snapshot") and n[:-9].isdigit())
    if snaps:
        state.apply(load(names[f"{snaps[-1]:09d}.snapshot"]), snaps[-1])
    for n in sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()):
        if n > state.version:
            state.apply(load(names[f"{n:09d}.json"]), n)
    return state


class Range(InputPartition):
    def __init__(self, partition: str, files: tuple[str, ...], first: int, end: int):
        self.partition, self.files, self.first, self.end = partition, files, first, end


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.root, self.topic = options["root"], options["topic"]
        named = [v for k, v in sorted(options.items()) if k.startswith("partition.")]
        self.named = set(named) if named else None
        self.max_rows = int(options.get("max_rows", 0))
        self.starting = options.get("starting", "earliest")
        self.names = [f.name for f in schema.fields]
        self.mark = options.get("fingerprint")
        self.at: dict[str, int] = {}

    def _spans(self) -> dict[str, tuple[int, int]]:
        state = read_state(self.root, self.topic)
        return {p: state.span(p) for p in state.partitions() if self.named is None or p in self.named}

    def initialOffset(self) -> dict:
        return {p: (b if self.starting == "latest" else a) for p, (a, b) in self._spans().items()}

    def latestOffset(self) -> dict:
        out = {}
        for p, (a, b) in self._spans().items():
            if self.max_rows:
                b = min(b, max(self.at.get(p, a), a) + self.max_rows)
            out[p] = b
        self.at = dict(out)
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        state = read_state(self.root, self.topic)
        out: list[InputPartition] = []
        for p, stop in sorted(end.items()):
            first = max(start.get(p, 0), state.span(p)[0])
            for s in mf.by_index(state.of(p), first):
                if s.record_start >= stop:
                    break
                if self.mark and s.fingerprint != self.mark:
                    raise ValueError(f"partition {p!r} changes its schema at row {s.record_start}")
                a, b = max(first, s.record_start), min(stop, s.record_end)
                if out and (out[-1].partition, out[-1].files, out[-1].end) == (p, s.files, a):
                    out[-1].end = b  # segments that share their files are read together
                else:
                    out.append(Range(p, s.files, a, b))
        self.at = dict(end)
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        for path in part.files:
            at, name = open_path(path)
            table = pq.read_table(name, filesystem=at, columns=self.names, filters=(pc.field("_index") >= part.first) & (pc.field("_index") < part.end), partitioning=None)
            yield from table.select(self.names).to_batches()

    def commit(self, end: dict) -> None:
        pass


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidemark"

    def _newest(self) -> tuple[str, str]:
        state = read_state(self.options["root"], self.options["topic"])
        last = max(state.segments.values(), key=lambda s: s.created, default=None)
        if last is None:
            raise ValueError(f"topic {self.options['topic']!r} has no rows yet")
        return last.fingerprint, state.schemas[last.fingerprint]

    def schema(self) -> T.StructType:
        own, _ = schemas.parse(self._newest()[1])
        return T.StructType([*EXTRA, *[T.StructField(f.name, f.dataType) for f in own.fields]])

    def streamReader(self, schema: T.StructType) -> TailReader:
        return TailReader(dict(self.options) | {"fingerprint": self._newest()[0]}, schema)
