"""Every catalogue query against its oracle in DuckDB."""

import os

import duckdb
import pytest

from tidemark.plans.queries import QUERIES, SQL, flagship

TABLES = "events documents embeddings".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_its_oracle(spark, sf_dir, duck, name):
    got = QUERIES[name](spark, sf_dir)
    want = duck.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    rows = [tuple(r[c] for c in names) for r in got.collect()]
    assert sorted(rows, key=repr) == sorted(want.fetchall(), key=repr)


def test_scans_stay_in_the_jvm(spark, sf_dir):
    for name in ("q01_topic_page_fwd", "q06_time_page", "q15_byte_limit", "q18_focus_flatten"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_the_entry_point_lists_them(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert flagship(spark, "/root/testdata/sf0.001").columns == ["time", "event_id", "value"]
