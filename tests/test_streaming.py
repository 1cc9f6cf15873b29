import json

import pytest
from fixtures import records, schema_b

from tidemark.operators.cursor import Limit
from tidemark.sources import formats
from tidemark.sources.store import LogStore, StoreError
from tidemark.streaming.replicate import replicate, replicate_stream
from tidemark.streaming.tail import TailReader, TailSource, read_state


@pytest.fixture
def stores(spark, tmp_path):
    return LogStore(spark, f"file://{tmp_path}/a"), LogStore(spark, f"file://{tmp_path}/b")


def test_replication(stores):
    a, b = stores
    for _ in range(3):
        a.append("t", "p", schema_b())
    assert replicate(a, "t", b) == 15
    a.append("t", "p", records([(0, "x")]))
    a.append("t", "q", schema_b())
    assert replicate(a, "t", b, max_rows=4) == 6
    assert b.partitions("t") == a.partitions("t") == {"p": (0, 16), "q": (0, 5)}
    for p in ("p", "q"):
        x, y = (s.records("t", p, 0, limit=Limit(100)) for s in (a, b))
        assert x.df.collect() == y.df.collect() and x.fingerprint == y.fingerprint
    b.append("t", "q", schema_b())
    with pytest.raises(StoreError):
        replicate(a, "t", b)


def test_tail_resumes_and_finds_new_partitions(spark, stores, tmp_path):
    a, b = stores
    a.append("t", "p", records([(i, f"m{i}") for i in range(5)]))
    q = replicate_stream(a.root, "t", b, "copy", f"file://{tmp_path}/ck")
    q.awaitTermination(90)
    assert b.partitions("copy") == {"p": (0, 5)}
    a.append("t", "p", records([(9, "later")]))
    a.append("t", "q", records([(1, "new")]))
    q = replicate_stream(a.root, "t", b, "copy", f"file://{tmp_path}/ck")
    q.awaitTermination(90)
    assert b.partitions("copy") == {"p": (0, 6), "q": (0, 1)}
    assert [r["message"] for r in b.records("copy", "p", 4).df.collect()] == ["m4", "later"]


def test_tail_reader_offsets(stores):
    a, _ = stores
    a.append("t", "p", records([(i, f"m{i}") for i in range(5)]))
    schema = TailSource({"root": a.root, "topic": "t"}).schema()
    reader = TailReader({"root": a.root, "topic": "t", "max_rows": "2"}, schema)
    assert reader.initialOffset() == {"p": 0} and reader.latestOffset() == {"p": 2} and reader.latestOffset() == {"p": 4}
    rows = [r for part in reader.partitions({"p": 1}, {"p": 4}) for b in reader.read(part) for r in b.to_pylist()]
    assert [(r["_index"], r["message"]) for r in rows] == [(1, "m1"), (2, "m2"), (3, "m3")]
    assert read_state(a.root, "t").span("p") == (0, 5)


def test_replies(stores):
    a, _ = stores
    a.append("t", "p", schema_b())
    page = a.records("t", "p", 1, limit=Limit(2))
    kind, body = formats.reply(page)
    assert kind == formats.RECORDS and json.loads(body) == [{"time": t, "inputs": w, "outputs": float(t + 1), "failures": []} for t, w in ((1, "two"), (2, "three"))]
    kind, body = formats.reply(page, formats.ARROW)
    table = formats.read_arrow_file(body)
    assert json.loads(table.schema.metadata[b"status"]) == {"status": "RecordLimited", "next": {"p": 3}}
    assert json.loads(table.schema.metadata[b"span"]) == {"start": 1, "end": 3} and table.num_rows == 2
    empty = a.records("t", "p", 5)
    assert formats.reply(empty)[1] == b"[]" and empty.status.value == "All"
    with pytest.raises(formats.CannotEmit):
        formats.reply(page, "text/html")
    assert [formats.status_code(e) for e in (formats.RequestTooLong(2, 1), formats.CannotEmit(), formats.SchemaError("NullType"), formats.ReadOnlyError(), ValueError())] == [413, 406, 400, 429, 500]
