"""``python -m tidemark --root DIR COMMAND``: look into, fill and keep a store."""

from __future__ import annotations

import argparse
import json
import sys

import pyarrow as pa
from pyspark.sql import SparkSession

from tidemark.operators.focus import DataFocus
from tidemark.sources.formats import read_arrow_file, records_json
from tidemark.sources.store import LogStore


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("--root", required=True)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("topics")
    for name in ("partitions", "compact", "recover"):
        c = sub.add_parser(name)
        c.add_argument("topic")
        if name == "compact":
            c.add_argument("partition")
    sub.add_parser("retain")
    for name in ("records", "iterate", "drain"):
        c = sub.add_parser(name)
        c.add_argument("topic")
        if name == "records":
            c.add_argument("partition")
            c.add_argument("start", type=int)
        else:
            c.add_argument("--cursor", type=json.loads, default={})
            c.add_argument("--partition", action="append", dest="partitions")
        c.add_argument("--page-size", type=int)
        c.add_argument("--order", default="asc")
        c.add_argument("--time-start")
        c.add_argument("--time-end")
        c.add_argument("--dataset", action="append", default=[])
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--separator")
        c.add_argument("--max-bytes", type=int)
    for name in ("append", "insert"):
        c = sub.add_parser(name)
        c.add_argument("topic")
        c.add_argument("partition")
        c.add_argument("file", help="an Arrow IPC file (append) or a JSON array of rows (insert)")
    c = sub.add_parser("replicate")
    c.add_argument("topic")
    c.add_argument("target")
    c = sub.add_parser("serve")
    c.add_argument("--host", default="127.0.0.1")
    c.add_argument("--port", type=int, default=3030)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = LogStore(spark, a.root)
    say = lambda x: print(json.dumps(x))

    def show(page) -> None:
        for r in records_json(page.df).collect() if page.rows else ():
            print(r["record"])

    if a.command == "topics":
        say(store.topics())
    elif a.command == "partitions":
        say(store.partitions(a.topic))
    elif a.command in ("records", "iterate", "drain"):
        query = {"page_size": a.page_size, "order": a.order, "time_start": a.time_start, "time_end": a.time_end, "focus": DataFocus(tuple(a.dataset), tuple(a.exclude), a.separator, a.max_bytes)}
        if a.command == "drain":
            for page in store.pages(a.topic, cursor=a.cursor, partitions=a.partitions, **query):
                show(page)
            return 0
        page = store.records(a.topic, a.partition, a.start, **query) if a.command == "records" else store.iterate(a.topic, a.cursor, partitions=a.partitions, **query)
        show(page)
        print(json.dumps({"status": page.status.value, "next": page.next}), file=sys.stderr)
    elif a.command in ("append", "insert"):
        data = open(a.file, "rb").read()
        table = read_arrow_file(data) if a.command == "append" else pa.Table.from_pylist(json.loads(data))
        say(store.append_batches(a.topic, a.partition, table))
    elif a.command == "compact":
        store.compact(a.topic, a.partition)
    elif a.command == "recover":
        say(store.recover(a.topic))
    elif a.command == "retain":
        say(store.retain())
    elif a.command == "replicate":
        from tidemark.streaming.replicate import replicate

        say(replicate(store, a.topic, LogStore(spark, a.target)))
    elif a.command == "serve":
        from tidemark.sources.service import serve

        serve(store, a.host, a.port).serve_forever()
    return 0


if __name__ == "__main__":
    sys.exit(main())
