import pytest
from fixtures import records, schema_a, schema_b

from tidemark.operators.cursor import InvalidQuery, Limit, Status
from tidemark.operators.focus import DataFocus
from tidemark.sources.schemas import SchemaError
from tidemark.sources.store import Config, LogStore, ReadOnlyError, RequestTooLong, Retention, Rolling, StoreError


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/store")


def texts(page):
    return [r["message"] for r in page.df.collect()]


def test_time_paging(store):
    rows = list(zip((0, 10, 12, 13, 14, 15), "uvwxyz"))
    for i, r in enumerate(rows):
        assert store.append("t", f"partition-{i % 3}", records([r])) == (i // 3, i // 3 + 1)
    span = {"time_start": 5000, "time_end": "1970-01-01T00:00:18Z"}
    names = [f"partition-{i}" for i in range(3)]
    page = store.iterate("t", None, page_size=2, **span)
    assert (page.status, page.next) == (Status.RECORD_LIMITED, dict(zip(names, [2, 1, 0])))
    assert texts(page) == ["x", "v"]
    page = store.iterate("t", page.next, page_size=1, **span)
    assert (page.status, page.next, texts(page)) == (Status.RECORD_LIMITED, dict(zip(names, [2, 1, 1])), ["w"])
    page = store.iterate("t", page.next, page_size=5, **span)
    assert (page.status, page.next, texts(page)) == (Status.ALL, dict(zip(names, [2, 2, 2])), ["y", "z"])
    page = store.iterate("t", page.next, page_size=1, **span)
    assert (page.status, page.next, page.rows) == (Status.ALL, dict(zip(names, [2, 2, 2])), 0)
    with pytest.raises(InvalidQuery):
        store.iterate("t", None, time_start=5)
    with pytest.raises(InvalidQuery):
        store.iterate("t", None, time_start=5, time_end=6, order="DESC")


@pytest.fixture
def mixed(store):
    a, b = schema_a(), schema_b()
    for name, chunks in {"p1": (a, a, a, b, b), "p2": (a, b, a, b, b), "p3": (a, a, a, a, b)}.items():
        for c in chunks:
            store.append("t", name, c)
    return store


def test_schema_changes(mixed):
    names = ["p1", "p2", "p3"]
    page = mixed.iterate("t", limit=Limit(100))
    assert (page.status, page.next) == (Status.SCHEMA_CHANGE, dict(zip(names, [15, 5, 20])))
    assert page.df.count() == 40 and page.df.columns == schema_a().column_names
    page = mixed.iterate("t", page.next, limit=Limit(5))
    # p2 comes first (position 5), then p1: the row limit is reached inside p2's schema-b chunk
    assert (page.status, page.next) == (Status.RECORD_LIMITED, dict(zip(names, [15, 10, 20])))
    page = mixed.iterate("t", page.next, limit=Limit(100))
    assert (page.status, page.next) == (Status.SCHEMA_CHANGE, dict(zip(names, [15, 15, 20])))
    page = mixed.iterate("t", page.next, limit=Limit(100))
    assert (page.status, page.next) == (Status.ALL, dict(zip(names, [25, 25, 25])))
    assert page.df.columns == schema_b().column_names


def test_schema_changes_in_reverse(mixed):
    want = [([15, 15, 20], Status.SCHEMA_CHANGE), ([0, 10, 0], Status.SCHEMA_CHANGE), ([0, 5, 0], Status.SCHEMA_CHANGE), ([0, 0, 0], Status.ALL)]
    cursor = None
    for position, status in want:
        page = mixed.iterate("t", cursor, order="desc", limit=Limit(100))
        cursor = page.next
        assert ([cursor[p] for p in ("p1", "p2", "p3")], page.status) == (position, status)


def test_reverse_tranches(store):
    for p in range(4):
        store.append("t", f"p{p}", records([(i, f"r{i}") for i in range(5 * p, 5 * p + 5)]))
    page = store.iterate("t", limit=Limit(5))
    assert texts(page) == ["r0", "r1", "r2", "r3", "r4"]
    page = store.iterate("t", limit=Limit(5), order="desc")
    assert texts(page) == ["r19", "r18", "r17", "r16", "r15"]
    assert page.next == {"p0": 5, "p1": 5, "p2": 5, "p3": 0}
    page = store.iterate("t", page.next, limit=Limit(7), order="desc")
    assert texts(page) == ["r14", "r13", "r12", "r11", "r10", "r9", "r8"]
    assert page.next == {"p0": 5, "p1": 3, "p2": 0, "p3": 0}
    # a cursor in reverse limits the scan to its partitions
    assert store.iterate("t", {"p0": 2}, order="desc").rows == 2


def test_byte_limit_keeps_whole_chunks(store):
    for a, b in ((0, 6), (6, 10), (10, 20)):
        store.append("t", "p", records([(i, "x" * 50) for i in range(a, b)]))
    for most in (250, 1):
        page = store.records("t", "p", 0, limit=Limit(10, most))
        assert (page.status, page.rows, page.span) == (Status.BYTE_LIMITED, 6, (0, 6))
    page = store.records("t", "p", 2, limit=Limit(10, 10_000))
    assert (page.status, page.rows, page.span, page.next) == (Status.RECORD_LIMITED, 10, (2, 12), {"p": 12})
    page = store.records("t", "p", 12, order="desc", limit=Limit(3))
    assert page.span == (9, 12) and page.next == {"p": 9}
    assert store.records("t", "p", 0, limit=Limit(0)).status is Status.RECORD_LIMITED


def test_unordered_times(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(roll=Rolling(max_rows=2)))
    times = [5, 6, 0, 10, 4, 3, 12, 2]
    for t in times:
        store.append("t", "p", records([(t, f"m{t}")]))
    assert [s.rows for s in store.manifest("t").refresh().of("p")] == [3, 3, 2]
    for start, lo, hi, most in ((0, 3, 6, 100), (1, 0, 5, 2), (3, 0, 12, 3), (8, 0, 12, 1), (0, 7, 9, 5), (0, 4, 4, 1)):
        want = [i for i, t in enumerate(times) if i >= start and lo <= t <= hi]
        page = store.records("t", "p", start, time_start=lo * 1000, time_end=hi * 1000, limit=Limit(most))
        kept = want[:most]
        assert texts(page) == [f"m{times[i]}" for i in kept] if kept else page.rows == 0
        assert page.status is (Status.RECORD_LIMITED if len(want) >= most else Status.ALL)
        assert page.next == {"p": kept[-1] + 1 if kept else start}


def test_retention_moves_the_start(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(roll=Rolling(max_rows=2), retain=Retention(max_segments=1)))
    for i in range(8):
        store.append("t", "p", records([(i, f"m{i}")]))
    assert store.partitions("t") == {"p": (6, 8)}
    page = store.records("t", "p", 0)
    assert texts(page) == ["m6", "m7"]
    with pytest.raises(StoreError):
        store.by_index("t", "p", 1)
    assert store.by_index("t", "p", 7).first()["message"] == "m7"


def test_global_retention_drops_the_oldest_first(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(roll=Rolling(max_rows=0), max_total_bytes=1500))
    for i in range(4):
        store.append(f"t{i % 2}", "p", records([(i, "x" * 500)]))
    assert store.size() == 4 * (500 + 8 + 4)
    assert store.retain() == 2
    assert store.partitions("t0") == {"p": (1, 2)} and store.partitions("t1") == {"p": (1, 2)}
    assert store.append("t0", "p", records([(9, "y")])) == (2, 3)


def test_compaction_keeps_rows_and_indices(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(chunk_rows=4))
    for i in range(7):
        store.append("t", "p", records([(i, f"m{i}")]))
    store.compact("t", "p")
    seg = store.manifest("t").refresh().of("p")[0]
    assert [c.rows for c in seg.chunks] == [4, 3] and len(seg.files) == 1
    assert texts(store.records("t", "p", 0)) == [f"m{i}" for i in range(7)]
    store.append("t", "p", records([(7, "m7")]))
    assert store.partitions("t") == {"p": (0, 8)}


def test_recovery(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(roll=Rolling(max_rows=2)))
    for i in range(8):
        store.append("t", "p", records([(i, f"m{i}")]))
    segs = store.manifest("t").refresh().of("p")
    store.files.delete(segs[-1].files[0])
    store.files.write(f"{store._topic('t')}/stray.parquet", "x")
    got = LogStore(spark, store.root).recover("t")
    assert got == {"orphans": 1, "segments": 1}
    again = LogStore(spark, store.root)
    assert again.partitions("t") == {"p": (0, 6)}
    assert again.append("t", "p", records([(9, "new")])) == (6, 7)
    assert texts(again.records("t", "p", 5)) == ["m5", "new"]


def test_bulk_append_by_column_indexes_in_order(store, spark):
    df = spark.range(1000).selectExpr("id * 10 as time", "cast(id % 3 as string) as k", "id as v").repartition(5)
    got = store.append_all("bulk", df, partition="k", order_by=["v"], chunk_rows=100)
    assert got == {"0": (0, 334), "1": (0, 333), "2": (0, 333)}
    rows = [(r["_partition"], r["_index"], r["v"], r["_chunk"]) for r in store.table("bulk").collect()]
    assert all(i == v // 3 and int(p) == v % 3 and c == i // 100 for p, i, v, c in rows) and len(rows) == 1000
    pages = list(store.pages("bulk", limit=Limit(300)))
    assert sum(p.rows for p in pages) == 1000 and pages[-1].status is Status.ALL
    store.register("bulk", "bulk_view")
    assert spark.sql("select sum(v) s from bulk_view").first()["s"] == 499500
    assert store.rows("bulk") == 1000


def test_selectors(store):
    for p in ("alpha", "beta", "a.b", "α"):
        store.append("t", p, records([(0, p)]))
    seen = lambda *s: sorted(texts(store.iterate("t", partitions=list(s))) if store.iterate("t", partitions=list(s)).rows else [])
    assert seen("alpha", "nope") == ["alpha"]
    assert seen("regex:^a") == ["a.b", "alpha"]
    assert seen("regex:eta", "α") == ["beta", "α"]
    assert seen(r"regex:\p{Greek}") == ["α"]
    assert seen(r"regex:\p{Unknown}") == [] and seen() == []
    assert seen("regex:(?=a)") == []


def test_bad_input(store, spark):
    import pyarrow as pa

    for data, kind in (
        (pa.table({"x": [1]}), "BadTime"),
        (pa.table({"time": pa.array([1], pa.int32())}), "BadTime"),
        (pa.table({"time": pa.array([None], pa.int64())}), "BadTime"),
        (pa.table({"time": [1], "n": pa.nulls(1)}), "NullType"),
        (pa.table({"time": [1], "_index": [1]}), "Reserved"),
        (pa.table({"time": pa.array([], pa.int64())}), "EmptyBody"),
    ):
        with pytest.raises(SchemaError) as e:
            store.append("t", "p", data)
        assert e.value.kind == kind
    small = LogStore(spark, store.root, Config(max_append_bytes=100))
    with pytest.raises(RequestTooLong):
        small.append_request("t", "p", records([(i, "x" * 20) for i in range(20)]))
    assert small.append_batches("t", "p", records([(i, "x" * 20) for i in range(12)]))[-1][1] == 12
    full = LogStore(spark, store.root, Config(min_free_bytes=1 << 62))
    assert not full.check_disk()
    with pytest.raises(ReadOnlyError):
        full.append("t", "p", records([(0, "x")]))


def test_focus_and_byte_nulls_in_pages(store):
    store.append("t", "p", schema_a())
    page = store.iterate("t", focus=DataFocus(("*",), separator=".", max_bytes=50))
    rows = [r.asDict() for r in page.df.collect()]
    assert list(rows[0]) == ["time", "tensor", "inputs", "outputs.mul", "outputs.tensor"]
    assert rows[0]["tensor"] is None and rows[1]["time"] == 1 and rows[0]["outputs.mul"] == 2.0
    page = store.iterate("t", focus=DataFocus(("outputs",)))
    assert page.df.columns == ["mul", "tensor"]


def test_metadata_is_part_of_the_schema(store):
    t = records([(0, "a")])
    store.append("t", "p", t.replace_schema_metadata({"k": "v"}))
    assert store.iterate("t").metadata == {"k": "v"}
    store.append("t", "p", t)
    assert store.iterate("t").status is Status.SCHEMA_CHANGE


def test_settings_and_metrics(spark, tmp_path):
    from tidemark.sources.settings import load, size

    path = tmp_path / "c.toml"
    path.write_text('max_total_bytes = "2 GiB"\n[roll]\nmax_rows = 7\nmax_seconds = 1.5\n')
    c = load(str(path), {"TIDEMARK__RETAIN__MAX_SEGMENTS": "3", "TIDEMARK__ROLL__MAX_BYTES": "1MB", "HOME": "x"})
    assert (c.max_total_bytes, c.roll.max_rows, c.roll.max_seconds, c.roll.max_bytes, c.retain.max_segments) == (2 << 30, 7, 1.5, 10**6, 3)
    assert load(environ={}) == Config() and size("1.5kb") == 1500
    for bad in ({"TIDEMARK__NOPE": "1"}, {"TIDEMARK__MAX_TOTAL_BYTES": "1 parsec"}):
        with pytest.raises(ValueError):
            load(environ=bad)
    store = LogStore(spark, f"file://{tmp_path}/s")
    store.append("t", "p", schema_a())
    store.append("t", "p", schema_b())
    row = store.metrics("t").first()
    assert (row.rows, row.segments, row.schemas, row.record_end) == (10, 2, 2, 10) and store.health()


def test_collator(store):
    from tidemark.streaming.batches import Collator

    with Collator(store, max_bytes=10_000, max_seconds=0) as c:
        c.add("t", "p", records([(0, "a")]))
        c.add("t", "q", records([(1, "b")]))
        c.add("t", "p", records([(2, "c")]))
        c.add("t", "p", schema_b())
        assert not store.topics()
        c.poll()
        assert store.partitions("t") == {"p": (0, 7), "q": (0, 1)}
        c.add("t", "q", records([(3, "d")]))
    assert store.partitions("t")["q"] == (0, 2)
    assert texts(store.records("t", "p", 0, limit=Limit(2))) == ["a", "c"]


def test_snapshots_shorten_the_log(store):
    from tidemark.sources import manifest as mf
    from tidemark.streaming.tail import read_state

    m = store.manifest("t")
    for i in range(mf.CHECKPOINT + 3):
        s = mf.Segment("p", i, "f", (f"file{i}",), (mf.Chunk(0, i * 10, 10, 5, i, i + 1),), 1.0)
        m.commit(lambda _, s=s: {"segments": [mf.dump(s)], "schemas": {"f": "x"}})
    names = m.files.names(m.log)
    assert [n for n in names if n.endswith(".snapshot")] == [f"{mf.CHECKPOINT - 1:09d}.snapshot"]
    for n in names[:5]:
        m.files.delete(f"{m.log}/{n}")
    fresh = mf.Manifest(store.spark, store._topic("t")).refresh()
    assert fresh.segments == m.refresh().segments == read_state(store.root, "t").segments and fresh.span("p") == (0, 350)
