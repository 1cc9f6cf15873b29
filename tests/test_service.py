import json
import threading
import urllib.error
import urllib.request

import pytest
from fixtures import nested, records, schema_b

from tidemark.__main__ import main
from tidemark.sources import formats
from tidemark.sources.service import serve
from tidemark.sources.store import Config, LogStore


@pytest.fixture
def base(spark, tmp_path):
    server = serve(LogStore(spark, f"file://{tmp_path}/s", Config(max_append_bytes=20_000)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_address[1]}"
    server.shutdown()


def call(url, data=None, accept=None):
    request = urllib.request.Request(url, data=data, headers={"accept": accept} if accept else {})
    try:
        with urllib.request.urlopen(request, timeout=120) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as e:
        return e.code, dict(e.headers), e.read()


def test_routes(base):
    code, _, body = call(f"{base}/topic/a%2Fb/partition/p", formats.arrow_file(nested()))
    assert (code, json.loads(body)) == (200, {"span": {"start": 0, "end": 5}})
    assert json.loads(call(f"{base}/topics")[2]) == {"topics": [{"name": "a/b"}]}
    assert json.loads(call(f"{base}/topic/a%2Fb")[2])["partitions"] == {"p": {"start": 0, "end": 5}}
    assert json.loads(call(f"{base}/ok")[2]) == {"ok": True}
    code, headers, body = call(f"{base}/topic/a%2Fb/records?page_size=2&dataset[]=*&dataset_separator=.", b"{}")
    assert json.loads(body)[1] == {"time": 1, "child.grandchild.index": 1, "child.index": 1}
    status = json.loads(headers["x-iteration-status"])
    assert status == {"status": "RecordLimited", "next": {"p": 2}}
    code, _, body = call(f"{base}/topic/a%2Fb/records?order=desc&page_size=1", json.dumps(status["next"]).encode(), formats.ARROW)
    assert formats.read_arrow_file(body).column("time").to_pylist() == [1]
    assert json.loads(call(f"{base}/topic/a%2Fb/partition/p/records?start=3&dataset=time")[2]) == [{"time": 3}, {"time": 4}]
    assert [call(f"{base}/topic/a%2Fb/{x}", d)[0] for x, d in (("records?dataset=no", b"{}"), ("records", b"[1]"), ("records?time.start=5", b"{}"), ("partition/p/records", None), ("partition/p", b"junk"), ("no/such", None))] == [400, 400, 400, 406, 400, 404]
    code, headers, _ = call(f"{base}/topic/x/partition/p", b"x" * 30_000)
    assert code == 413 and headers["x-max-request-size"] == "20000"


def test_command_line(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/s"
    (tmp_path / "a.arrow").write_bytes(formats.arrow_file(schema_b()))
    (tmp_path / "rows.json").write_text(json.dumps([{"time": 1, "message": "hi"}]))
    run = lambda *a: main(["--root", root, *a], spark)
    assert run("append", "t", "p", str(tmp_path / "a.arrow")) == 0 and run("insert", "u", "q", str(tmp_path / "rows.json")) == 0
    run("topics")
    run("partitions", "t")
    run("iterate", "t", "--page-size", "1", "--dataset", "inputs")
    run("drain", "u")
    run("replicate", "t", f"file://{tmp_path}/copy")
    out = capsys.readouterr().out.splitlines()
    assert out == ["[[0, 5]]", "[[0, 1]]", '["t", "u"]', '{"p": [0, 5]}', '{"inputs":"one"}', '{"time":1,"message":"hi"}', "5"]
    assert records([(0, "x")]).num_rows == 1
