import threading
import time

import pyarrow as pa
import pytest
from fixtures import records, schema_a, schema_b

from tidemark.sources.client import Client, ServiceError
from tidemark.sources.service import Writers, openapi, serve
from tidemark.sources.store import Config, LogStore, ReadOnlyError, Rolling, StoreError, WriterBusy


@pytest.fixture
def live(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(max_append_bytes=5_000))
    server = serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield store, Client(f"http://127.0.0.1:{server.server_address[1]}")
    server.shutdown()


def test_client_learns_the_limit_and_reads_pages(live):
    store, client = live
    rows = records([(i, f"{i:03d}" + "x" * 40) for i in range(120)])
    assert client.append("t/1", "p", rows) == (0, 120)
    assert client.max_bytes == 5_000 and client.max_rows < 120
    assert client.topics() == ["t/1"] and client.partitions("t/1") == {"p": (0, 120)} and client.healthy()
    table, status, cursor = client.iterate("t/1", page_size=50)
    assert (table.num_rows, status, cursor) == (50, "RecordLimited", {"p": 50})
    assert client.records("t/1", "p", 118)[0].column("message").to_pylist() == [f"{i:03d}" + "x" * 40 for i in (118, 119)]
    whole = client.stack("t/1", page_size=50)
    assert whole.column("time").to_pylist() == rows.column("time").to_pylist()
    assert client.stack("t/1", {"p": 120}).num_rows == 0
    with pytest.raises(ServiceError) as e:
        client.append("t/1", "p", records([(0, "y" * 9000)]))
    assert e.value.code == 413
    # a schema change ends a drain, as it ends a scan
    client.max_rows = None
    client.append("u", "p", schema_a())
    client.append("u", "p", schema_b())
    assert client.stack("u").column_names == schema_a().column_names


def test_service_documents_itself_and_its_health(live):
    store, client = live
    client.append("t", "p", records([(0, "a")]))
    assert set(openapi()["paths"]) >= {"/ok", "/topics", "/topic/{topic}/records"}
    assert b"/openapi.json" in client._call("docs")[1] and b'"3.0.3"' in client._call("openapi.json")[1]
    text = client._call("metrics")[1].decode()
    assert 'tidemark_rows_written_total{topic="t"} 1' in text and 'tidemark_rows{topic="t"} 1' in text and "tidemark_writable 1" in text
    store.config = Config(min_free_bytes=1 << 62)
    store._checked = float("-inf")
    assert not client.healthy()
    client.retries = 0
    with pytest.raises(ServiceError) as e:
        client.append("t", "p", records([(0, "a")]))
    assert e.value.code == 429


def test_writers_shed_load():
    w, entered, go = Writers(1, 0.05), threading.Event(), threading.Event()

    def hold():
        with w.writing("t"):
            entered.set()
            go.wait(10)

    first = threading.Thread(target=hold)
    first.start()
    entered.wait(10)
    second = threading.Thread(target=hold)  # waits in the queue
    second.start()
    time.sleep(0.05)
    with pytest.raises(WriterBusy), w.writing("t"):
        pass
    with w.writing("other"):
        pass
    go.set()
    first.join(10)
    second.join(10)
    with w.writing("t"):
        pass


def test_appends_stop_while_there_is_no_room(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(min_free_bytes=1 << 62))
    for append in (lambda: store.append("t", "p", records([(0, "x")])), lambda: store.append_all("t", spark.range(3).selectExpr("id as time", "id as k"), partition="k")):
        with pytest.raises(ReadOnlyError):
            append()
    assert not store.health() and store.topics() == []
    store.config = Config(check_disk_seconds=0)
    assert store.append("t", "p", records([(0, "x")])) == (0, 1) and store.health()


def test_chunks_of_bulk_appends_stay_in_files(spark, tmp_path):
    config = Config(inline_chunks=4, roll=Rolling(max_rows=60))
    store = LogStore(spark, f"file://{tmp_path}/s", config)
    df = pa.table({"time": list(range(400)), "k": [str(i % 2) for i in range(400)], "v": list(range(400))})
    store.append("t", "0", pa.table({"time": [7], "k": ["0"], "v": [7]}))
    assert store.append_all("t", df, partition="k", order_by=["v"], chunk_rows=10) == {"0": (1, 201), "1": (0, 200)}
    store.append("t", "0", pa.table({"time": [8], "k": ["0"], "v": [8]}))
    own = store.manifest("t").refresh().of("0")
    assert sum(s.rows for s in own) == 202 and [s.record_start for s in own] == sorted(s.record_start for s in own) and own[-1].record_end == 202
    assert all(len(s.chunks) <= 1 for s in own) and sum(s.n_chunks for s in own) == 22
    plain = LogStore(spark, f"file://{tmp_path}/plain", Config(roll=config.roll))
    plain.append("t", "0", pa.table({"time": [7], "k": ["0"], "v": [7]}))
    plain.append_all("t", df, partition="k", order_by=["v"], chunk_rows=10)
    plain.append("t", "0", pa.table({"time": [8], "k": ["0"], "v": [8]}))
    for query in ({"page_size": 35}, {"page_size": 35, "order": "desc"}, {"page_size": 30, "time_start": 50, "time_end": 333}, {"page_size": 1000, "page_bytes": 900}):
        a, b = list(store.pages("t", **query)), list(plain.pages("t", **query))
        assert [(p.rows, p.status, p.next) for p in a] == [(p.rows, p.status, p.next) for p in b] and len(a) > 1
        assert [p.df.collect() for p in a] == [p.df.collect() for p in b]
    assert [r.v for r in store.stack("t", page_size=70).collect()] == [r.v for p in plain.pages("t", page_size=70) for r in p.df.collect()]
    fresh = LogStore(spark, store.root, config)
    assert fresh.records("t", "1", 33, page_size=3).df.count() == 3
    # upkeep: chunk files go with the last segment that needs them, and aren't orphans before
    assert fresh.recover("t") == {"orphans": 0, "segments": 0}
    fresh.compact("t", "1")
    assert sum(s.n_chunks for s in fresh.manifest("t").refresh().of("1")) < 20 and fresh.records("t", "1", 0, page_size=500).rows == 200


def test_a_broken_newest_segment_is_left_out(spark, tmp_path):
    store = LogStore(spark, f"file://{tmp_path}/s", Config(roll=Rolling(max_rows=0)))
    for p in ("a", "b"):
        for i in range(3):
            store.append("t", p, records([(i, f"{p}{i}")]))
    segs = store.manifest("t").refresh()
    store.files.delete(segs.of("a")[-1].files[0])
    at = segs.of("b")[-1].files[0]
    store.files.delete(at.rpartition("/")[0] + "/." + at.rpartition("/")[2] + ".crc")
    store.files.write(at, "junk")
    # opening finds the missing file, reading all finds the broken one
    opened = LogStore(spark, store.root)
    assert opened.partitions("t") == {"a": (0, 2), "b": (0, 3)}
    assert LogStore(spark, store.root, Config(recover_on_open=False)).recover("t")["segments"] == 1
    assert LogStore(spark, store.root).partitions("t") == {"a": (0, 2), "b": (0, 2)}


def test_one_of_two_writers_wins_a_commit(spark, tmp_path):
    files = LogStore(spark, f"file://{tmp_path}/s").files
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(files.publish(f"file://{tmp_path}/log/1.json", f"writer {k}")), daemon=True) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join(60)
    assert sum(won) == 1 and files.read(f"file://{tmp_path}/log/1.json").startswith("writer") and files.names(f"file://{tmp_path}/log") == ["1.json"]


def test_worker_runs_jobs_of_a_config(spark, tmp_path):
    from tidemark.streaming.replicate import Worker

    a, b = LogStore(spark, f"file://{tmp_path}/a"), LogStore(spark, f"file://{tmp_path}/b")
    for p in "xyz":
        a.append("t", p, records([(1, p), (2, p)]))
    a.append("u", "x", records([(5, "u")]))
    config = {"hosts": {"a": a.root}, "topics": [{"source": {"host": "a", "topic": "u"}, "target": {"host": "self", "topic": "copy"}}], "partitions": [{"source": {"host": "a", "topic": "t", "partition": p}, "target": {"host": "self", "topic": f"t-{p}", "partition": p}} for p in "xz"]}
    worker = Worker.from_config(spark, config, own=b)
    assert worker.pump() == 5 and not worker.failed
    assert b.partitions("copy") == {"x": (0, 1)} and b.partitions("t-x") == {"x": (0, 2)} and b.topics() == ["copy", "t-x", "t-z"]
    with pytest.raises(StoreError):
        Worker.from_config(spark, {**config, "hosts": {}}, own=b)


def test_collation_is_one_commit(spark, tmp_path):
    from tidemark.streaming.batches import Collator

    store = LogStore(spark, f"file://{tmp_path}/s")
    with Collator(store, max_bytes=1 << 20) as c:
        for i in range(12):
            c.add("t", f"p{i % 4}", records([(i, f"m{i}")]))
    state = store.manifest("t").refresh()
    assert state.version == 0 and store.partitions("t") == {f"p{i}": (0, 3) for i in range(4)}
    assert [r["message"] for r in store.records("t", "p1", 0).df.collect()] == ["m1", "m5", "m9"]
