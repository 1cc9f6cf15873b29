"""Queries over virtual topics made of the benchmark tables.

``events`` is a topic with event types as partitions and event ids as order.
Each query uses the same operators as the log store; only the rows come from
a plain table instead of segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.latency import quantiles
from tidemark.functions.sizing import byte_size, row_size
from tidemark.functions.timing import millis
from tidemark.operators import focus as fx
from tidemark.operators import scan
from tidemark.operators.cursor import Limit, Order

CURSOR = {"click": 100, "purchase": 40, "view": 7}
REVERSE = {"click": 300, "purchase": 900, "view": 500}
LOW, HIGH = 1_704_412_800_000, 1_705_708_800_000  # 2024-01-05 and 2024-01-20

LOG_SQL = """log AS (SELECT event_type AS "partition", row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS record_index,
 epoch_us(ts) // 1000 AS time, event_id, user_id, value FROM events)"""


def _case(cursor: dict[str, int], default: str) -> str:
    return 'CASE "partition" ' + " ".join(f"WHEN '{k}' THEN {v}" for k, v in sorted(cursor.items())) + f" ELSE {default} END"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a log."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select(millis(F.col("ts")).alias("time"), "event_id", "user_id", "value", "event_type")
    return scan.index_rows(df, F.col("event_type"), F.col("event_id")).drop("event_type")


def shown(df: DataFrame) -> DataFrame:
    return df.select(F.col("_partition").alias("partition"), F.col("_index").alias("record_index"), "time", "event_id", "user_id")


SHOWN = 'SELECT "partition", record_index, time, event_id, user_id'
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _store(spark: SparkSession, name: str, **config):
    """A store of its own under the folder that all executors share."""
    from tidemark.sources.store import Config, LogStore

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return LogStore(spark, f"{base}/{name}-{uuid.uuid4().hex}", Config(**config))


def _rows(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(millis(F.col("ts")).alias("time"), "event_id", "user_id", "value", "event_type")


def _ingest(spark, d, store, topic, order=("event_id",), **options):
    return store.append_all(topic, _rows(spark, d), partition="event_type", order_by=list(order), **options)


def _thirds(**retain):
    """Settings by which a segment holds 300 rows, in chunks of 100; nothing is dropped unless ``retain`` says so."""
    from tidemark.sources.store import Retention, Rolling

    return {"roll": Rolling(max_rows=300), "retain": Retention(**{"max_segments": EVERY, "max_bytes": 1 << 50, **retain})}


EVERY = 1 << 40


@query("q01_topic_page_fwd", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(CURSOR, "0")} AS s FROM log) {SHOWN} FROM s WHERE record_index >= s ORDER BY s, "partition", record_index LIMIT 1500')
def q01(spark, d):
    return shown(scan.page(events(spark, d), CURSOR, 1500))


@query("q02_topic_page_rev", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(REVERSE, "0")} AS s FROM log WHERE "partition" IN (\'click\', \'purchase\', \'view\')) {SHOWN} FROM s WHERE record_index < s ORDER BY s DESC, "partition" DESC, record_index DESC LIMIT 1000')
def q02(spark, d):
    return shown(scan.page(events(spark, d), REVERSE, 1000, Order.REVERSE))


@query("q03_partition_page_fwd", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE \"partition\" = 'view' AND record_index >= 50 ORDER BY record_index LIMIT 200")
def q03(spark, d):
    return shown(scan.partition_page(events(spark, d), "view", 50, 200))


@query("q04_partition_page_rev", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE \"partition\" = 'view' AND record_index < 150 ORDER BY record_index DESC LIMIT 120")
def q04(spark, d):
    return shown(scan.partition_page(events(spark, d), "view", 150, 120, Order.REVERSE))


@query("q05_time_range", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE time BETWEEN {LOW} AND {HIGH} AND record_index >= 10")
def q05(spark, d):
    return shown(scan.in_time(events(spark, d), LOW, HIGH).where("_index >= 10"))


@query("q06_time_page", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(CURSOR, "0")} AS s FROM log) {SHOWN} FROM s WHERE record_index >= s AND time BETWEEN {LOW} AND {HIGH} ORDER BY s, "partition", record_index LIMIT 200')
def q06(spark, d):
    return shown(scan.page(scan.in_time(events(spark, d), LOW, HIGH), CURSOR, 200))


@query("q07_filter_exact", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE \"partition\" IN ('click', 'view')")
def q07(spark, d):
    return shown(scan.in_partitions(events(spark, d), ["click", "view", "absent"]))


@query("q08_filter_regex", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE regexp_matches(\"partition\", 'i[ce]|^pur') OR \"partition\" = 'signup'")
def q08(spark, d):
    return shown(scan.in_partitions(events(spark, d), ["regex:i[ce]|^pur", "signup"]))


@query("q09_spans", f'WITH {LOG_SQL} SELECT "partition", min(record_index) AS start_index, max(record_index) + 1 AS end_index FROM log GROUP BY 1')
def q09(spark, d):
    return scan.spans(events(spark, d)).select(F.col("_partition").alias("partition"), F.col("start").alias("start_index"), F.col("end").alias("end_index"))


SEGMENTS = f"""WITH {LOG_SQL}, g AS (SELECT "partition", record_index // 300 AS segment, min(record_index) AS record_start, max(record_index) + 1 AS record_end,
 min(time) AS time_start, max(time) AS time_end, count(*) AS n FROM log GROUP BY 1, 2)"""


def _segments(spark, d):
    got = scan.segments(events(spark, d), F.expr("_index div 300"))
    return got.select(F.col("_partition").alias("partition"), F.col("_segment").alias("segment"), "record_start", "record_end", "time_start", "time_end", F.col("rows").alias("n"))


@query("q10_segments", SEGMENTS + ' SELECT "partition", segment, record_start, record_end, time_start, time_end, n FROM g')
def q10(spark, d):
    return _segments(spark, d)


@query("q11_segment_prune_time", SEGMENTS + f' SELECT "partition", segment FROM g WHERE time_start <= {HIGH} AND time_end >= {LOW} AND record_end > 10')
def q11(spark, d):
    return scan.overlapping(_segments(spark, d), LOW, HIGH, 10).select("partition", "segment")


@query("q12_next_cursor_fwd", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(CURSOR, "0")} AS s FROM log), p AS (SELECT * FROM s WHERE record_index >= s ORDER BY s, "partition", record_index LIMIT 1500), m AS (SELECT "partition", max(record_index) + 1 AS x FROM p GROUP BY 1) SELECT DISTINCT s."partition", coalesce(x, s) AS next_index FROM s LEFT JOIN m USING ("partition")')
def q12(spark, d):
    log = events(spark, d)
    return scan.advance(scan.page(log, CURSOR, 1500), CURSOR, scan.spans(log)).select(F.col("_partition").alias("partition"), F.col("next").alias("next_index"))


@query("q13_next_cursor_rev", f'WITH {LOG_SQL}, e AS (SELECT "partition", max(record_index) + 1 AS s FROM log GROUP BY 1), s AS (SELECT log.*, s FROM log JOIN e USING ("partition")), p AS (SELECT * FROM s ORDER BY s DESC, "partition" DESC, record_index DESC LIMIT 300), m AS (SELECT "partition", min(record_index) AS x FROM p GROUP BY 1) SELECT e."partition", coalesce(x, s) AS next_index FROM e LEFT JOIN m USING ("partition")')
def q13(spark, d):
    log = events(spark, d)
    got = scan.advance(scan.page(log, {}, 300, Order.REVERSE), {}, scan.spans(log), Order.REVERSE)
    return got.select(F.col("_partition").alias("partition"), F.col("next").alias("next_index"))


@query("q14_status", f"WITH {LOG_SQL}, p AS (SELECT * FROM log WHERE time BETWEEN {LOW} AND {HIGH} LIMIT 500) SELECT count(*) AS n, CASE WHEN count(*) >= 500 THEN 'RecordLimited' ELSE 'All' END AS status FROM p")
def q14(spark, d):
    """Rows and status of a time page of a store."""
    store = _store(spark, "status")
    _ingest(spark, d, store, "events")
    page = store.iterate("events", time_start=LOW, time_end=HIGH, limit=Limit(500))
    return spark.createDataFrame([(page.df.count(), page.status.value)], "n long, status string")


@query("q15_byte_limit", f"""WITH {LOG_SQL}, r AS (SELECT *, record_index // 100 AS chunk, 4 + 8 + 8 + 8 + 8 AS b FROM log),
 c AS (SELECT "partition", chunk, sum(b) AS b FROM r GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(b) OVER (ORDER BY "partition", chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 {SHOWN} FROM r JOIN k USING ("partition", chunk) WHERE before < 25500""")
def q15(spark, d):
    log = events(spark, d).select("_partition", "_index", "time", "event_id", "user_id", "value")
    sized = log.withColumn("_bytes", row_size(log.drop("_partition", "_index").schema)).withColumn("_chunk", F.expr("_index div 100"))
    return shown(scan.byte_limited(sized, 25_500, ("_partition", "_chunk")))


@query("q16_chunk_compaction", f'WITH {LOG_SQL} SELECT "partition", record_index // 1000 AS chunk, count(*) AS n, min(record_index) AS record_start FROM log GROUP BY 1, 2')
def q16(spark, d):
    """Chunks of 100 rows, compacted by the store's rule."""
    from tidemark.sources.store import Rolling

    store = _store(spark, "compact", chunk_rows=1000, chunk_bytes=EVERY, roll=Rolling(max_rows=EVERY, max_bytes=EVERY))
    for p in _ingest(spark, d, store, "events", chunk_rows=100):
        store.compact("events", p)
    got = store.table("events").groupBy(F.col("_partition").alias("partition"), F.col("_chunk").alias("chunk"))
    return got.agg(F.count(F.lit(1)).alias("n"), F.min("_index").alias("record_start"))


@query("q17_max_bytes_null", """WITH l AS (SELECT vec_id, label, embedding, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) // 7 AS chunk FROM embeddings),
 b AS (SELECT *, sum(4 * len(embedding)) OVER (PARTITION BY label, chunk) AS b FROM l)
 SELECT vec_id, CASE WHEN b <= 1600 THEN len(embedding) END AS n_values FROM b""")
def q17(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("time"), "vec_id", "embedding", "label")
    log = scan.index_rows(v, F.col("label"), F.col("vec_id")).withColumn("_chunk", F.expr("_index div 7"))
    got = fx.apply(log.select("_partition", "_chunk", "_index", "vec_id", "embedding"), fx.DataFocus(("vec_id", "embedding"), max_bytes=1600))
    return got.select("vec_id", F.size("embedding").alias("n_values")).withColumn("n_values", F.when(F.col("n_values") >= 0, F.col("n_values")).cast("long"))


def _nested(spark, d):
    e = events(spark, d)
    return e.select("time", F.struct("event_id", F.struct("user_id", "value").alias("who")).alias("body"))


@query("q18_focus_flatten", f'WITH {LOG_SQL} SELECT time, event_id AS "body.event_id", user_id AS "body.who.user_id" FROM log')
def q18(spark, d):
    return fx.apply(_nested(spark, d), fx.DataFocus(("*",), exclude=("body.who.value",), separator="."))


@query("q19_focus_exclude", f'WITH {LOG_SQL} SELECT event_id AS "body.event_id" FROM log')
def q19(spark, d):
    return fx.apply(_nested(spark, d), fx.DataFocus(("*",), exclude=("time", "body.who"), separator="."))


@query("q20_focus_unwrap", f"WITH {LOG_SQL} SELECT user_id, value FROM log")
def q20(spark, d):
    return fx.apply(fx.get_table(_nested(spark, d), ["body"]), fx.DataFocus(("who",)))


@query("q21_topic_rows", f"WITH {LOG_SQL}, s AS (SELECT max(record_index) + 1 - min(record_index) AS n FROM log GROUP BY \"partition\") SELECT sum(n)::bigint AS n_rows FROM s")
def q21(spark, d):
    return scan.spans(events(spark, d)).agg(F.sum(F.col("end") - F.col("start")).alias("n_rows"))


@query("q22_topic_bytes", 'SELECT source AS "partition", sum(8 + 8 + coalesce(octet_length(encode(text)), 0) + coalesce(octet_length(encode(lang)), 0) + 4)::bigint AS n_bytes FROM documents GROUP BY 1')
def q22(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("time"), "doc_id", "text", "lang", "source")
    return docs.groupBy(F.col("source").alias("partition")).agg(F.sum(row_size(docs.drop("source").schema)).alias("n_bytes"))


@query("q23_oldest_segment", SEGMENTS + ' SELECT "partition", segment, time_start FROM g ORDER BY time_start, "partition", segment LIMIT 1')
def q23(spark, d):
    return _segments(spark, d).orderBy("time_start", "partition", "segment").limit(1).select("partition", "segment", "time_start")


@query("q24_retention_survivors", SEGMENTS + ', k AS (SELECT *, row_number() OVER (PARTITION BY "partition" ORDER BY segment DESC) AS r FROM g) SELECT "partition", segment, record_start, record_end FROM k WHERE r <= 3')
def q24(spark, d):
    """What a store keeps of each partition under a bound of three segments."""
    store = _store(spark, "retain", **_thirds(max_segments=3))
    _ingest(spark, d, store, "events", chunk_rows=100)
    return store.manifest("events").df().select("partition", "segment", "record_start", "record_end")


BY_TIME = """log AS (SELECT event_type AS "partition", row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS record_index, epoch_us(ts) // 1000 AS time FROM events),
 g AS (SELECT "partition", record_index // 300 AS segment, min(time) AS time_start, count(*) AS n, sum(36 + strlen("partition")) AS b FROM log GROUP BY 1, 2)"""


@query("q25_global_retention", f'WITH {BY_TIME}, k AS (SELECT *, sum(b) OVER (ORDER BY time_start DESC, "partition" DESC, segment DESC ROWS UNBOUNDED PRECEDING) AS kept FROM g) SELECT "partition", segment, n FROM k WHERE kept <= 90000')
def q25(spark, d):
    """What the store's global rule leaves of a topic in time order: the oldest segments go until the rest is within the budget."""
    store = _store(spark, "budget", max_total_bytes=90_000, **_thirds())
    _ingest(spark, d, store, "events", order=("time", "event_id"), chunk_rows=100)
    store.retain()
    return store.manifest("events").df().select("partition", "segment", F.col("rows").alias("n"))


@query("q26_drain_all", f"WITH {LOG_SQL} {SHOWN} FROM log")
def q26(spark, d):
    return shown(events(spark, d))


@query("q27_concat", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE \"partition\" = 'click' UNION ALL {SHOWN} FROM log WHERE \"partition\" = 'view'")
def q27(spark, d):
    log = events(spark, d)
    return shown(log.where("_partition = 'click'").unionAll(log.where("_partition = 'view'")))


@query("q28_schema_run_page", f"""WITH {LOG_SQL}, s AS (SELECT *, record_index // 60 % 2 AS mark FROM log), b AS (SELECT "partition", min(record_index) AS stop FROM s WHERE mark = 1 GROUP BY 1)
 {SHOWN} FROM s LEFT JOIN b USING ("partition") WHERE mark = 0 AND (stop IS NULL OR record_index < stop)""")
def q28(spark, d):
    """A page of a store in which every partition changes its schema after 60 rows, and back after 120."""
    store, log = _store(spark, "schemas"), events(spark, d)
    columns = ["time", "event_id", "user_id"]
    part = lambda a, b, own: store.append_all("events", log.where(F.col("_index").between(a, b - 1)), partition="_partition", order_by=["_index"], columns=own)
    part(0, 60, columns)
    part(60, 120, [*columns, "value"])
    part(120, EVERY, columns)
    page = store.iterate("events", limit=Limit(EVERY, EVERY)).df
    return shown(page.join(log.select("_partition", "_index", "event_id"), "event_id"))


@query("q29_multi_topic", "SELECT DISTINCT source AS topic FROM documents WHERE source IS NOT NULL")
def q29(spark, d):
    """The topics of a store that has one for each source."""
    from concurrent.futures import ThreadPoolExecutor

    store = _store(spark, "topics")
    names = [r.source for r in spark.read.parquet(f"{d}/documents.parquet").where("source is not null").groupBy("source").count().toLocalIterator()]
    with ThreadPoolExecutor(8) as pool:
        list(pool.map(lambda x: store.append(x, "p", [{"time": 0, "name": x}]), names))
    return spark.createDataFrame([(t,) for t in store.topics()], "topic string")


@query("q30_pandas_records", f"""WITH {LOG_SQL}, p AS (SELECT * FROM log WHERE "partition" = (SELECT min("partition") FROM log) ORDER BY record_index LIMIT 50)
 SELECT '{{"time":' || time || ',"event_id":' || event_id || ',"value":' || value || '}}' AS record FROM p""")
def q30(spark, d):
    from tidemark.sources.formats import records_json

    return records_json(scan.page(events(spark, d), {}, 50).select("time", "event_id", "value"))


STORED = f'WITH {LOG_SQL} SELECT "partition", record_index, time, event_id, user_id FROM log'


@query("q31_replicated_equals_source", STORED)
def q31(spark, d):
    """A topic written to a store, replicated page by page to another, and read back."""
    from tidemark.streaming.replicate import replicate

    source, target = _store(spark, "source"), _store(spark, "target")
    _ingest(spark, d, source, "events")
    replicate(source, "events", target, "events")
    return shown(target.table("events"))


@query("q32_store_page", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(CURSOR, "0")} AS s FROM log) SELECT time, event_id, user_id FROM s WHERE record_index >= s ORDER BY s, "partition", record_index LIMIT 1500')
def q32(spark, d):
    """The page of q01 from a store, through its manifest."""
    store = _store(spark, "page")
    _ingest(spark, d, store, "events")
    return store.iterate("events", CURSOR, limit=Limit(1500)).df.select("time", "event_id", "user_id")


@query("q33_append_spans", f'WITH {LOG_SQL} SELECT "partition", min(record_index) AS start_index, max(record_index) + 1 AS end_index FROM log GROUP BY 1')
def q33(spark, d):
    store = _store(spark, "append")
    got = _ingest(spark, d, store, "events")
    return spark.createDataFrame([(p, a, b) for p, (a, b) in sorted(got.items())], "`partition` string, start_index long, end_index long")


@query("q34_column_bytes", "SELECT sum(4 * len(embedding))::bigint AS embedding_bytes, sum(8)::bigint AS id_bytes FROM embeddings")
def q34(spark, d):
    v = spark.read.parquet(f"{d}/embeddings.parquet")
    return v.agg(F.sum(byte_size(F.col("embedding"), v.schema["embedding"].dataType)).alias("embedding_bytes"), F.sum(byte_size(F.col("vec_id"), v.schema["vec_id"].dataType)).alias("id_bytes"))


@query("q35_time_minmax", f'WITH {LOG_SQL} SELECT "partition", min(time) AS time_start, max(time) AS time_end FROM log GROUP BY 1')
def q35(spark, d):
    return events(spark, d).groupBy(F.col("_partition").alias("partition")).agg(F.min("time").alias("time_start"), F.max("time").alias("time_end"))


@query("q36_latency_quantiles", f"""WITH {LOG_SQL}, g AS (SELECT "partition", time - lag(time) OVER (PARTITION BY "partition" ORDER BY record_index) AS gap FROM log)
 SELECT "partition", count(gap) AS n, quantile_disc(gap, 0.5) AS p50, quantile_disc(gap, 0.9) AS p90, quantile_disc(gap, 0.99) AS p99 FROM g GROUP BY 1""")
def q36(spark, d):
    """Quantiles of the time between a partition's rows: each row meets its predecessor by an equi-join on the index."""
    log = events(spark, d).select("_partition", "_index", "time")
    before = log.select("_partition", (F.col("_index") + 1).alias("_index"), F.col("time").alias("_before"))
    gaps = log.join(before, ["_partition", "_index"])
    return quantiles(gaps.withColumnRenamed("_partition", "partition"), F.col("time") - F.col("_before"), ["partition"], accuracy=1_000_000)


@query("q37_store_metrics", f'WITH {LOG_SQL} SELECT "partition", count(*) AS n_rows, sum(36 + strlen("partition"))::bigint AS n_bytes, min(time) AS time_start, max(time) AS time_end FROM log GROUP BY 1')
def q37(spark, d):
    store = _store(spark, "metrics")
    _ingest(spark, d, store, "events")
    return store.metrics("events").select("partition", F.col("rows").alias("n_rows"), F.col("bytes").alias("n_bytes"), "time_start", "time_end")


@query("q38_time_page_from_store", f'WITH {LOG_SQL}, s AS (SELECT *, 0 AS s FROM log) SELECT time, event_id, user_id FROM s WHERE time BETWEEN {LOW} AND {HIGH} ORDER BY s, "partition", record_index LIMIT 700')
def q38(spark, d):
    """A time page through the manifest: pruned segments, chunk statistics, the fold, then the rows."""
    store = _store(spark, "time")
    _ingest(spark, d, store, "events")
    return store.iterate("events", time_start=LOW, time_end=HIGH, limit=Limit(700)).df.select("time", "event_id", "user_id")


@query("q39_reverse_page_from_store", f'WITH {LOG_SQL}, e AS (SELECT "partition", max(record_index) + 1 AS s FROM log GROUP BY 1), s AS (SELECT log.*, s FROM log JOIN e USING ("partition")) SELECT time, event_id, user_id FROM s ORDER BY s DESC, "partition" DESC, record_index DESC LIMIT 700')
def q39(spark, d):
    store = _store(spark, "reverse")
    _ingest(spark, d, store, "events")
    return store.iterate("events", order="desc", limit=Limit(700)).df.select("time", "event_id", "user_id")


@query("q40_point_lookup", f"WITH {LOG_SQL} {SHOWN} FROM log WHERE \"partition\" = 'view' AND record_index = 17")
def q40(spark, d):
    store = _store(spark, "lookup")
    _ingest(spark, d, store, "events")
    return shown(store.by_index("events", "view", 17))


@query("q41_partition_page_from_store", f"WITH {LOG_SQL} SELECT time, event_id, user_id FROM log WHERE \"partition\" = 'view' AND record_index < 150 ORDER BY record_index DESC LIMIT 120")
def q41(spark, d):
    """The page of q04 from a store, its cursor inside a chunk."""
    store = _store(spark, "partition")
    _ingest(spark, d, store, "events")
    return store.records("events", "view", 150, order="desc", page_size=120).df.select("time", "event_id", "user_id")


@query("q42_stacked_pages", STORED)
def q42(spark, d):
    """All pages of a store, one after the other, as one DataFrame."""
    store = _store(spark, "stack", inline_chunks=4)
    _ingest(spark, d, store, "events")
    got = store.stack("events", limit=Limit(30_000, EVERY))
    return shown(got.join(events(spark, d).select("_partition", "_index", "event_id"), "event_id"))


@query("q43_recovered_rows", f'WITH {LOG_SQL}, k AS (SELECT "partition", max(record_index) // 100 AS last FROM log GROUP BY 1) SELECT log."partition", record_index, time, event_id, user_id FROM log JOIN k USING ("partition") WHERE record_index // 100 < last')
def q43(spark, d):
    """What is left after each partition's newest segment has lost its files, by a store opened anew."""
    from tidemark.sources.store import LogStore, Rolling

    store = _store(spark, "recover", **_thirds() | {"roll": Rolling(max_rows=100)})
    _ingest(spark, d, store, "events", chunk_rows=100)
    state = store.manifest("events").refresh()
    for p in state.partitions():
        for f in state.of(p)[-1].files:
            store.files.delete(f)
    opened = LogStore(spark, store.root, store.config)
    opened.recover("events")
    return shown(opened.table("events"))


@query("q44_tailed_rows", STORED)
def q44(spark, d):
    """A topic read as a stream, all that is there."""
    from tidemark.streaming.tail import TailSource

    store = _store(spark, "tail")
    _ingest(spark, d, store, "events")
    spark.dataSource.register(TailSource)
    rows = spark.readStream.format("tidemark").option("root", store.root).option("topic", "events").load()
    out = f"{store.root}/out"
    run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{store.root}/checkpoint").trigger(availableNow=True).start()
    run.awaitTermination()
    return shown(spark.read.schema(rows.schema).parquet(out))


@query("q45_arrow_reply", f'WITH {LOG_SQL}, s AS (SELECT *, {_case(CURSOR, "0")} AS s FROM log) SELECT time, event_id, user_id FROM s WHERE record_index >= s ORDER BY s, "partition", record_index LIMIT 300')
def q45(spark, d):
    """A page as the service's Arrow reply, read back."""
    from tidemark.sources import formats

    store = _store(spark, "arrow")
    _ingest(spark, d, store, "events")
    kind, body = formats.reply(store.iterate("events", CURSOR, page_size=300), formats.ARROW)
    table = formats.read_arrow_file(body)
    return spark.createDataFrame(table.select(["time", "event_id", "user_id"]).replace_schema_metadata(None))


@query("q46_byte_page_from_store", f"""WITH {LOG_SQL}, r AS (SELECT *, record_index // 100 AS chunk, 36 + strlen("partition") AS b FROM log),
 c AS (SELECT "partition", chunk, sum(b) AS b FROM r GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(b) OVER (ORDER BY "partition", chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c)
 SELECT time, event_id, user_id FROM r JOIN k USING ("partition", chunk) WHERE before < 25500""")
def q46(spark, d):
    """A page of limited bytes: whole chunks up to the one that reaches the limit."""
    store = _store(spark, "bytes")
    _ingest(spark, d, store, "events", chunk_rows=100)
    return store.iterate("events", limit=Limit(EVERY, 25_500)).df.select("time", "event_id", "user_id")


@query("q47_time_page_by_text", f'WITH {LOG_SQL} SELECT time, event_id, user_id FROM log WHERE time BETWEEN {LOW} AND {HIGH} ORDER BY "partition", record_index LIMIT 200')
def q47(spark, d):
    """Times given as RFC 3339 texts, one of them in another zone."""
    store = _store(spark, "text")
    _ingest(spark, d, store, "events")
    return store.iterate("events", time_start="2024-01-05T00:00:00Z", time_end="2024-01-20T02:00:00+02:00", page_size=200).df.select("time", "event_id", "user_id")


@query("q48_collated_spans", f'WITH {LOG_SQL} SELECT "partition", 0 AS start_index, least(60, max(record_index) + 1) AS end_index FROM log GROUP BY 1')
def q48(spark, d):
    """The first rows of each partition, gathered from small tables and appended in one commit."""
    from tidemark.streaming.batches import Collator

    store = _store(spark, "collate")
    table = events(spark, d).where("_index < 60").orderBy("_partition", "_index").toArrow()
    with Collator(store, max_bytes=EVERY) as c:
        for at in range(0, table.num_rows, 7):
            part = table.slice(at, 7)
            for p in dict.fromkeys(part.column("_partition").to_pylist()):
                c.add("events", p, part.filter(pc.equal(part.column("_partition"), p)).select(["time", "event_id", "user_id", "value"]))
    return spark.createDataFrame([(p, a, b) for p, (a, b) in sorted(store.partitions("events").items())], "`partition` string, start_index long, end_index long")


@query("q49_rows_over_http", f"WITH {LOG_SQL} SELECT time, event_id, user_id FROM log WHERE \"partition\" = 'view' AND record_index < 400")
def q49(spark, d):
    """Rows sent to the service by its client, within a limit that the client has to learn, and read back page by page."""
    import threading

    from tidemark.sources.client import Client
    from tidemark.sources.service import serve

    store = _store(spark, "http", max_append_bytes=12_000)
    server = serve(store, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        client = Client(f"http://127.0.0.1:{server.server_address[1]}")
        rows = events(spark, d).where("_partition = 'view' and _index < 400").orderBy("_index").select("time", "event_id", "user_id").toArrow()
        client.append("events", "view", rows)
        return spark.createDataFrame(client.stack("events", page_size=150))
    finally:
        server.shutdown()


@query("q50_replicated_by_worker", STORED)
def q50(spark, d):
    """A topic replicated partition by partition, jobs side by side, until nothing moves."""
    from tidemark.streaming.replicate import Worker

    source, target = _store(spark, "from"), _store(spark, "to")
    spans = _ingest(spark, d, source, "events")
    ends = lambda p: ({"host": "a", "topic": "events", "partition": p}, {"host": "self", "topic": p, "partition": p})
    jobs = [dict(zip(("source", "target"), ends(p))) for p in spans]
    Worker.from_config(spark, {"hosts": {"a": source.root}, "partitions": jobs, "parallel": 4}, own=target).pump()
    return shown(reduce(DataFrame.unionAll, [target.table(p) for p in sorted(spans)]))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The first forward page of the topic, focused."""
    page = scan.page(events(spark, d), {}, 100)
    return fx.apply(page.select("time", "event_id", "value"), fx.DataFocus(("time", "event_id", "value")))
