"""Bulk appends of small segments: they share files, and each is kept, dropped, compacted and read by itself."""

import pyarrow as pa
import pytest

from tidemark.operators.cursor import Limit
from tidemark.operators.focus import DataFocus
from tidemark.sources.store import Config, LogStore, Retention, Rolling

CONFIG = dict(roll=Rolling(max_rows=10), inline_chunks=4)


def rows(n, at=0):
    return pa.table({"time": list(range(at, at + n)), "k": [str(i % 2) for i in range(n)], "v": list(range(at, at + n))})


@pytest.fixture
def make(spark, tmp_path):
    def open_(n=400, **config):
        store = LogStore(spark, f"file://{tmp_path}/s", Config(**CONFIG | config))
        if n:
            store.append_all("t", rows(n), partition="k", order_by=["v"], chunk_rows=10)
        return store

    return open_


def files(store):
    return {f for f, _ in store.files.walk(store._topic("t")) if f.endswith(".parquet") and "/_chunks/" not in f}


def values(store, p):
    got = sorted((r["_index"], r["v"]) for r in store.table("t", partitions=[p]).collect())
    assert [v for _, v in got] == [r["v"] for r in store.iterate("t", partitions=[p], limit=Limit(1 << 30, 1 << 40)).df.collect()]
    return got


def test_small_segments_share_files(make):
    store = make()
    own = store.manifest("t").refresh().of("0")
    assert len(own) == 20 and [s.rows for s in own] == [10] * 20
    # the newest has files of its own, as it may be lost or appended to
    assert not set(own[-1].files) & {f for s in own[:-1] for f in s.files}
    assert len(files(store)) < 20 and files(store) == {f for s in store.manifest("t").refresh().segments.values() for f in s.files}
    assert values(store, "0") == [(i, 2 * i) for i in range(200)]
    assert store.by_index("t", "1", 57).first()["v"] == 115
    assert [r["v"] for r in store.records("t", "1", 95, order="desc", page_size=20).df.collect()] == [2 * i + 1 for i in range(94, 74, -1)]
    # the next append goes on
    store.append_all("t", rows(60, 400), partition="k", order_by=["v"], chunk_rows=10)
    assert [v for _, v in values(store, "0")] == list(range(0, 460, 2))


def test_newest_segments_are_lost_alone(make):
    store = make()
    for p in "01":
        for f in store.manifest("t").refresh().of(p)[-1].files:
            store.files.delete(f)
    again = LogStore(store.spark, store.root, store.config)
    assert again.recover("t") == {"orphans": 0, "segments": 2} and again.partitions("t") == {"0": (0, 190), "1": (0, 190)}
    assert values(again, "1") == [(i, 2 * i + 1) for i in range(190)]
    # numbers that are used again don't bring back what shared files hold
    again._drop("t", again.manifest("t").refresh().of("1")[15:])
    assert [i for i, _ in values(again, "1")] == list(range(150))
    again.append_all("t", rows(40, 1000), partition="k", order_by=["v"], chunk_rows=10)
    assert values(again, "1") == [(i, 2 * i + 1) for i in range(150)] + [(190 + i, 1001 + 2 * i) for i in range(20)]


def test_shared_files_go_with_their_last_segment(make):
    store = make(retain=Retention(max_segments=3), file_rows=50)
    assert {p: [s.segment for s in store.manifest("t").refresh().of(p)] for p in "01"} == {"0": [17, 18, 19], "1": [17, 18, 19]}
    assert values(store, "0") == [(i, 2 * i) for i in range(170, 200)]
    assert files(store) == {f for s in store.manifest("t").refresh().segments.values() for f in s.files}
    store.config = Config(**CONFIG, max_total_bytes=3 * store.manifest("t").refresh().of("0")[0].size)
    assert store.retain() == 3 and store.rows("t") == 30
    assert files(store) == {f for s in store.manifest("t").refresh().segments.values() for f in s.files}


def test_compacted_segments_leave_shared_files(make):
    store = make(chunk_rows=10)
    store.append_all("t", rows(400, 400), partition="k", order_by=["v"], chunk_rows=5)
    before = store.manifest("t").refresh().of("1")
    shared = before[5].files
    store.config = Config(**CONFIG | {"chunk_rows": 10})
    store.compact("t", "1")
    assert all(s.n_chunks == s.rows // 10 for s in store.manifest("t").refresh().of("1"))
    assert values(store, "1") == [(i, 2 * i + 1) for i in range(400)] and values(store, "0") == [(i, 2 * i) for i in range(400)]
    assert files(store) == {f for s in store.manifest("t").refresh().segments.values() for f in s.files} and shared


def test_a_manifest_row_of_many_segments_is_small(make):
    store = make()
    m = store.manifest("t")
    (name,) = [n for n in m.files.names(m.log) if n.endswith(".json")]
    assert len(m.files.read(f"{m.log}/{name}")) < 40 * 150
    fresh = LogStore(store.spark, store.root, store.config)
    assert fresh.manifest("t").refresh().segments == m.refresh().segments


def test_tailed_segments_that_share_files_are_one_read(make):
    from tidemark.streaming.tail import TailReader

    store = make()
    schema = store.table("t").schema
    reader = TailReader({"root": store.root, "topic": "t"}, schema)
    parts = reader.partitions({}, {"0": 200, "1": 45})
    assert sum(p.end - p.first for p in parts) == 245 and len(parts) == 3
    got = [v for p in parts if p.partition == "1" for b in reader.read(p) for v in b.to_pydict()["v"]]
    assert sorted(got) == [2 * i + 1 for i in range(45)]


def test_compaction_looks_a_row_up_once(make, monkeypatch):
    """A row's chunk is found by a join on its old one, not by going through all chunks of its segment."""
    store = make(roll=Rolling(max_rows=1 << 40), chunk_rows=20)
    plans = []
    write = LogStore._write
    monkeypatch.setattr(store, "_write", lambda rows, out: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(rows, out)))
    store.compact("t", "0")
    (plan,) = plans
    assert "filter(" not in plan and "Join Inner" in plan
    rows = store.table("t", partitions=["0"]).collect()
    assert sorted((r["_index"], r["_chunk"], r["v"]) for r in rows) == [(i, i // 20, 2 * i) for i in range(200)]
    (s,) = store.manifest("t").refresh().of("0")
    assert [(c.chunk, c.index_start, c.rows) for c in s.chunks] == [(k, 20 * k, 20) for k in range(10)]


def test_stacked_pages_are_one_read(make):
    """All pages together aren't gathered in one task, and are the pages' rows in their order."""
    store = make()
    store.append_all("t", rows(90, 400), partition="k", order_by=["v"], chunk_rows=7)
    for query in ({"limit": Limit(33, 1 << 40)}, {"limit": Limit(33, 1 << 40), "order": "desc"}, {"page_size": 31, "time_start": 50, "time_end": 433}, {"page_size": 1000, "page_bytes": 500}, {"page_size": 45, "page_bytes": 1200, "focus": DataFocus(("v",), max_bytes=40)}):
        want = [tuple(r) for p in store.pages("t", **query) for r in p.df.collect()]
        got = store.stack("t", **query)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "TakeOrdered" not in plan and "SinglePartition" not in plan
        assert [tuple(r) for r in got.collect()] == want and len(want) > 300
    assert store.stack("t", cursor={"0": 245, "1": 245}) is None


def test_a_cursor_inside_a_chunk_takes_no_job(make, monkeypatch):
    store = make()
    store.append_all("t", rows(90, 400), partition="k", order_by=["v"], chunk_rows=7)
    measured = []
    stats = LogStore._stats
    monkeypatch.setattr(LogStore, "_stats", lambda self, *a: measured.append(a) or stats(self, *a))
    page = store.records("t", "0", 13, limit=Limit(20, 1 << 40))
    assert (page.next, page.span) == ({"0": 33}, (13, 33)) and not measured
    page = store.records("t", "0", 38, order="desc", limit=Limit(20, 1 << 40))
    assert (page.next, page.span) == ({"0": 18}, (18, 38)) and not measured
    # where the bytes may end the page, they are measured
    assert store.records("t", "0", 13, limit=Limit(1000, 120)).rows == 7 and measured
