"""Replication of topics between stores.

A target holds a prefix of its source: the next row it needs is its own end.
Rows are copied by runs of one schema, all partitions at once, as one bulk
append each; a batch is ordinary distributed work and nothing passes the
driver. A second writer at the target, or a source that has dropped rows the
target still needs, is an error.
"""

from __future__ import annotations

import functools
import time
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.selectors import select_names
from tidemark.sources import manifest as mf
from tidemark.sources import schemas
from tidemark.sources.store import LogStore, StoreError


def step(source: LogStore, topic: str, target: LogStore, target_topic: str, partitions: Sequence[str] | None = None, max_rows: int | None = None) -> int:
    """Copy the next run of one schema of every partition that is behind; the rows copied."""
    state, have = source.manifest(topic).refresh(), target.manifest(target_topic).refresh()
    by_mark: dict[str, list[tuple[str, int, int, list[mf.Segment]]]] = {}
    for p in select_names(source.spark, partitions, state.partitions()):
        at = have.ends.get(p, 0)
        first, end = state.span(p)
        if at > end:
            raise StoreError(f"partition {p!r}: the target is ahead of its source")
        if at == end:
            continue
        if at < first:
            raise StoreError(f"partition {p!r}: the source has dropped rows {at} to {first}")
        run: list[mf.Segment] = []
        for s in mf.by_index(state.of(p), at):
            if run and s.fingerprint != run[0].fingerprint:
                break
            run.append(s)
        stop = min(run[-1].record_end, at + max_rows) if max_rows else run[-1].record_end
        by_mark.setdefault(run[0].fingerprint, []).append((p, at, stop, [s for s in run if s.record_start < stop]))
    copied = 0
    for mark, runs in by_mark.items():
        text = state.schemas[mark]
        rows = source._read(topic, [s for *_, segs in runs for s in segs], state)
        bounds = source.spark.createDataFrame([(p, a, b) for p, a, b, _ in runs], "_partition string, _from long, _to long")
        rows = rows.join(F.broadcast(bounds), "_partition").where("_index >= _from and _index < _to")
        names = schemas.parse(text)[0].names
        target.append_all(target_topic, rows, partition="_partition", order_by=["_index"], columns=names, schema_text=text)
        copied += sum(b - a for _, a, b, _ in runs)
    return copied


def replicate(source: LogStore, topic: str, target: LogStore, target_topic: str | None = None, partitions: Sequence[str] | None = None, max_rows: int | None = None) -> int:
    """Copy until nothing is left; the rows copied."""
    total = 0
    while n := step(source, topic, target, target_topic or topic, partitions, max_rows):
        total += n
    return total


class Worker:
    """Runs replication jobs, up to ``parallel`` at once; a job copies some rows and says how many."""

    def __init__(self, jobs: Sequence[Callable[[], int]], parallel: int = 8):
        self.jobs, self.parallel = list(jobs), parallel
        #: the error of each job's last round, by its place
        self.failed: dict[int, Exception] = {}

    @classmethod
    def from_config(cls, spark: SparkSession, config: Mapping, own: LogStore | None = None) -> Worker:
        """From ``hosts`` (id: root of a store), ``topics`` and ``partitions`` (each with source and target: host, topic, and partition).

        The host ``self`` is ``own``.
        """
        hosts = {k: LogStore(spark, root) for k, root in config.get("hosts", {}).items()} | ({"self": own} if own else {})
        jobs = []
        for job in [*config.get("topics", ()), *config.get("partitions", ())]:
            a, b = job["source"], job["target"]
            for end in (a, b):
                if end["host"] not in hosts:
                    raise StoreError(f"unknown host {end['host']!r}")
            if a.get("partition") != b.get("partition"):
                raise StoreError("a partition keeps its name")
            names = [a["partition"]] if "partition" in a else None
            jobs.append(functools.partial(step, hosts[a["host"]], a["topic"], hosts[b["host"]], b["topic"], names, config.get("max_rows")))
        return cls(jobs, config.get("parallel", 8))

    def round(self) -> int:
        """One run of every job; the rows copied. A job that fails leaves the others be."""
        self.failed = {}

        def run(k: int) -> int:
            try:
                return self.jobs[k]()
            except StoreError as e:
                self.failed[k] = e
                return 0

        with ThreadPoolExecutor(self.parallel) as pool:
            return sum(pool.map(run, range(len(self.jobs))))

    def pump(self) -> int:
        """Rounds until nothing moves; the rows copied."""
        total = 0
        while n := self.round():
            total += n
        return total

    def run_forever(self, stop: Callable[[], bool] = lambda: False, least: float = 0.5, most: float = 60.0) -> None:
        """Rounds until ``stop``; after idle or failed rounds it waits ever longer."""
        wait = least
        while not stop():
            moved = self.round()
            wait = least if moved else min(most, wait * 2)
            if not stop():
                time.sleep(wait)


def run_forever(jobs: Sequence[Callable[[], int]], stop: Callable[[], bool] = lambda: False, least: float = 0.5, most: float = 60.0) -> None:
    """``Worker(jobs).run_forever``."""
    Worker(jobs).run_forever(stop, least, most)


def replicate_stream(source_root: str, topic: str, target: LogStore, target_topic: str, checkpoint: str, **trigger):
    """A streaming query that appends every batch of the source to the target, exactly once by row index."""
    from .tail import TailSource

    spark = target.spark
    spark.dataSource.register(TailSource)

    def write(batch: DataFrame, _: int) -> None:
        have = target.manifest(target_topic).refresh().ends
        if have:  # rows of a batch that a lost run has already written are known by their index
            ends = spark.createDataFrame(sorted(have.items()), "_partition string, _end long")
            batch = batch.join(F.broadcast(ends), "_partition", "left").where("_end is null or _index >= _end")
        names = [c for c in batch.columns if c not in ("_partition", "_index", "_end")]
        target.append_all(target_topic, batch, partition="_partition", order_by=["_index"], columns=names)

    rows = spark.readStream.format("tidemark").option("root", source_root).option("topic", topic).load()
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
