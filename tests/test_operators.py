import datetime
import json

import pyarrow as pa
import pytest
from fixtures import nested, records, schema_a, schema_b
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.sizing import byte_size, row_size
from tidemark.functions.timing import parse_rfc3339, to_millis
from tidemark.operators import focus as fx
from tidemark.operators import scan
from tidemark.operators.budget import ChunkStat, compaction, fold
from tidemark.operators.cursor import InvalidQuery, Limit, Order, Status
from tidemark.sources import manifest as mf
from tidemark.sources import schemas


@pytest.fixture(scope="module")
def tree(spark):
    return spark.createDataFrame(nested())


@pytest.mark.parametrize(
    ("focus", "columns"),
    [
        (fx.DataFocus(("child",)), ["grandchild", "index"]),
        (fx.DataFocus(("time",)), ["time"]),
        (fx.DataFocus(("child",), separator="."), ["child.grandchild.index", "child.index"]),
        (fx.DataFocus(("time", "child"), separator="."), ["time", "child.grandchild.index", "child.index"]),
        (fx.DataFocus(("*",), separator="."), ["time", "child.grandchild.index", "child.index"]),
        (fx.DataFocus(("*",), ("time",), "."), ["child.grandchild.index", "child.index"]),
        (fx.DataFocus(("*",), ("child.grandchild",), "."), ["time", "child.index"]),
        (fx.DataFocus(("*",), ("child",), "."), ["time"]),
        (fx.DataFocus(("*",), ("child.index",), "."), ["time", "child.grandchild.index"]),
        (fx.DataFocus(("time", "time")), ["time", "time"]),
        (fx.DataFocus(), ["time", "child"]),
    ],
)
def test_focus(tree, focus, columns):
    got = fx.apply(tree, focus)
    assert got.columns == columns and got.count() == 5


def test_focus_errors(tree):
    for path, kind, where in (([], "Empty", []), (["child", "missing", "x"], "KeyMissing", ["child", "missing"]), (["time", "no", "x"], "NotStruct", ["time"])):
        with pytest.raises(fx.PathError) as e:
            fx.resolve(tree.schema, path)
        assert (e.value.kind, e.value.path) == (kind, where)
    with pytest.raises(fx.PathError):
        fx.apply(tree, fx.DataFocus(("missing",), ("missing",)))
    with pytest.raises(fx.PathError):
        fx.apply(tree, fx.DataFocus((), ("time",)))


def test_nesting(tree):
    assert fx.tables(tree.schema) == [["child"], ["child", "grandchild"]]
    assert fx.arrays(tree.schema) == [["time"], ["child", "grandchild", "index"], ["child", "index"]]
    assert fx.get_table(tree, ["child", "grandchild"]).columns == ["index"]
    assert fx.from_struct(fx.to_struct(tree, "row"), "row").columns == tree.columns


def test_byte_sizes(spark):
    t = spark.createDataFrame([(1, "añ", [1.0, 2.0], ["x", "yz", None], {"k": 1}, None)], "a long, b string, c array<double>, d array<string>, e map<string,int>, f string")
    got = t.select(*[byte_size(F.col(f.name), f.dataType).alias(f.name) for f in t.schema.fields]).first()
    assert tuple(got) == (8, 3, 16, 3, 5, 0)
    assert spark.createDataFrame(schema_a()).select(row_size(spark.createDataFrame(schema_a()).schema).alias("b")).first()["b"] == 4 + 8 + 16 + 4 + 4 + 16
    with pytest.raises(TypeError):
        byte_size(F.col("x"), T.NullType())


def test_times():
    assert parse_rfc3339("1970-01-01T00:00:01.5Z") == 1500
    assert parse_rfc3339("1970-01-01T01:00:00.0009+01:00") == 0
    assert to_millis(datetime.datetime(1970, 1, 1, 0, 0, 2)) == 2000 and to_millis(7) == 7
    with pytest.raises(ValueError):
        parse_rfc3339("1970-01-01")
    with pytest.raises(TypeError):
        to_millis(1.5)
    assert Order.parse("DESC") is Order.REVERSE
    with pytest.raises(InvalidQuery):
        Order.parse("up")


def seg(n, lo, hi, a, b):
    return mf.Segment("p", n, "f", (), (mf.Chunk(0, a, b - a, 12, lo, hi),))


SEGMENTS = [seg(0, 500, 600, 0, 10), seg(1, 580, 800, 10, 20), seg(2, 820, 900, 20, 30), seg(3, 590, 800, 30, 40)]


@pytest.mark.parametrize(
    ("start", "lo", "hi", "want"),
    [
        (0, 400, 400, []), (0, 500, 500, [0]), (0, 520, 520, [0]), (0, 585, 585, [0, 1]), (0, 595, 595, [0, 1, 3]), (0, 700, 700, [1, 3]), (0, 850, 850, [2]), (0, 910, 910, []),
        (0, 400, 499, []), (0, 910, 1000, []), (0, 400, 500, [0]), (0, 400, 585, [0, 1]), (0, 400, 700, [0, 1, 3]), (0, 501, 700, [0, 1, 3]), (22, 501, 700, [3]), (0, 820, 850, [2]),
        (0, 601, 700, [1, 3]), (0, 500, 1000, [0, 1, 2, 3]), (12, 500, 1000, [1, 2, 3]), (20, 520, 1000, [2, 3]), (0, 705, 1000, [1, 2, 3]), (0, 850, 1000, [2]), (0, 250, 1000, [0, 1, 2, 3]),
    ],
)
def test_segments_by_time(spark, start, lo, hi, want):
    assert [s.segment for s in mf.by_time(SEGMENTS, lo, hi, start)] == want


def test_manifest_rows_agree_with_pruning(spark):
    df = spark.createDataFrame([s.row() for s in SEGMENTS])
    for lo, hi, start in ((595, 595, 0), (501, 700, 22), (850, 1000, 0)):
        assert sorted(r["segment"] for r in scan.overlapping(df, lo, hi, start).collect()) == [s.segment for s in mf.by_time(SEGMENTS, lo, hi, start)]
    assert [s.segment for s in mf.by_index(SEGMENTS, 20, reverse=True)] == [1, 0]
    assert mf.oldest(SEGMENTS).segment == 0


def test_index_rows_needs_no_single_task(spark):
    df = spark.range(-50, 950).selectExpr("id * 7 % 1009 as o", "cast(id % 2 as string) as p").where("o is not null")
    got = scan.index_rows(df, F.col("p"), F.col("o"), width=64)
    rows = sorted((r["_partition"], r["_index"], r["o"]) for r in got.collect())
    for p in ("0", "1"):
        own = [(i, o) for q, i, o in rows if q == p]
        assert [i for i, _ in own] == list(range(len(own))) and [o for _, o in own] == sorted(o for _, o in own)


def test_page_is_a_top_k(spark):
    log = spark.range(100).selectExpr("id as time", "'p' as _partition", "id as _index")
    plan = scan.page(log, {"p": 5}, 10)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan
    assert [r["_index"] for r in scan.page(log, {"p": 5}, 3).collect()] == [5, 6, 7]
    assert [r["_index"] for r in scan.page(log, {}, 3, Order.REVERSE).collect()] == [99, 98, 97]


def stat(p, n, rows, first, mark="a", size=10):
    return ChunkStat(p, 0, n, mark, rows, size, first, first + rows - 1)


def test_fold_leaves_other_schemas_and_keeps_its_budget():
    data = {"x": [stat("x", 0, 5, 0), stat("x", 1, 5, 5, "b")], "y": [stat("y", 0, 5, 0, "b")], "z": [stat("z", 0, 5, 0)]}
    got = fold([(0, "x"), (0, "y"), (0, "z")], lambda p, _: data[p], Limit(100, 1000), Order.FORWARD, {"x": 0, "y": 0, "z": 0})
    assert got.status is Status.SCHEMA_CHANGE and got.next == {"x": 5, "y": 0, "z": 5} and [p.stat.partition for p in got.pieces] == ["x", "z"]
    got = fold([(0, "x"), (0, "z")], lambda p, _: data[p][:1], Limit(7), Order.FORWARD, {"x": 0, "z": 0})
    assert got.status is Status.RECORD_LIMITED and got.cut.take == 2
    got = fold([(0, "x")], lambda p, _: data[p][:1], Limit(100, 10), Order.FORWARD, {"x": 0})
    assert got.status is Status.BYTE_LIMITED and got.next == {"x": 5}


def test_compaction_rule():
    assert list(compaction([(1, 1)] * 5, 2, 100)) == [0, 0, 1, 1, 2]
    assert list(compaction([(3000, 1), (1, 1), (1, 1)], 1000, 100)) == [0, 1, 1]
    assert list(compaction([(1, 60), (1, 60), (1, 1)], 1000, 100)) == [0, 0, 1]


def test_arrow_types_reach_spark(spark):
    t = pa.table(
        {
            "time": pa.array([1], pa.int64()), "u8": pa.array([1], pa.uint8()), "u16": pa.array([1], pa.uint16()), "u32": pa.array([1], pa.uint32()), "u64": pa.array([2**63], pa.uint64()),
            "h": pa.array([1.5], pa.float32()).cast(pa.float16()), "d": pa.array([datetime.date(2020, 1, 2)], pa.date64()), "t": pa.array([1], pa.int32()).cast(pa.time32("s")),
            "l": pa.array([[1, 2]], pa.list_(pa.uint8(), 2)), "dict": pa.array(["x"]).dictionary_encode(), "b": pa.array([b"x"], pa.large_binary()),
        }
    )
    df = spark.createDataFrame(schemas.normalise(t))
    row = df.first()
    assert (row.u64, row.h, row.l, row.dict, row.d) == (2**63, 1.5, [1, 2], "x", datetime.date(2020, 1, 2))
    text = schemas.canonical(df.schema, {"a": "b"})
    assert schemas.parse(text)[1] == {"a": "b"} and schemas.fingerprint(text) != schemas.fingerprint(schemas.canonical(df.schema))
    assert schemas.contains_null_type(T.ArrayType(T.NullType()))
    assert json.loads(text)["metadata"] == {"a": "b"}
    assert records([(1, "x")]).num_rows == 1 and schema_b().num_rows == 5
