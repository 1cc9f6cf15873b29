"""Line dedup by site-relative frequency, in DataFrame operations only.

A line is compared by its trimmed text. For each host, the number of its pages
that hold a line is divided by the host's number of pages; a line on more than
``ratio`` of them (and on at least ``min_pages`` pages) is boilerplate and all
its occurrences on that host go. Blank lines are never counted and stay.

Counting: the distinct line hashes of each page are exploded and aggregated by
(host, hash), which combines before the shuffle, so that a line on a third of
all pages costs one partial row for each task. What is dropped is bounded by
lines-per-page / ratio for each host. It is gathered to one row a host and
joined with the pages; the join is a broadcast only if the whole list has been
counted to be under ``broadcast_lines``, else a hash join on (host, salt) with
``salts`` copies of the host rows, so that a hot host spreads over many tasks.

Defined results: null text stays null with 0 lines; null hosts form one host;
an empty text has one blank line; repeated pages each count as a page, or with
``copies_once`` pages of a host with the same lines (trimmed, less blank ones)
count as one page; a line repeated inside a page counts once for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_keys(text: Column) -> Column:
    """Hashes of the trimmed lines, null for blank ones."""
    return F.transform(F.split(text, "\n"), lambda x: F.when(F.trim(x) != "", F.xxhash64(F.trim(x))))


def boilerplate_lines(pages: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.02, min_pages: int = 3, copies_once: bool = False) -> DataFrame:
    """(host, line hash, pages, host_pages) of the lines over the ratio."""
    if copies_once:  # pages meet as hashes of their lines, without their texts
        slim = pages.select(F.col(host).alias("_host"), F.filter(line_keys(F.col(text)), lambda x: x.isNotNull()).alias("_lines"))
        slim = slim.groupBy("_host", F.xxhash64("_lines").alias("_page")).agg(F.first("_lines").alias("_lines"))
    else:
        slim = pages.select(F.col(host).alias("_host"), line_keys(F.col(text)).alias("_lines"))
    totals = slim.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    lines = (
        slim.where(F.col("_lines").isNotNull())
        .select("_host", F.explode(F.array_distinct("_lines")).alias("_line"))
        .where(F.col("_line").isNotNull())
        .groupBy("_host", "_line")
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )
    return lines.join(totals, lines["_host"].eqNullSafe(totals["_host"])).where(F.col("pages") > ratio * F.col("host_pages")).select(lines["_host"], "_line", "pages", "host_pages")


def drop_boilerplate(pages: DataFrame, *, text: str = "text", host: str = "source", ratio: float = 0.02, min_pages: int = 3, broadcast_lines: int = 1_000_000, salts: int = 64, copies_once: bool = False) -> DataFrame:
    """``pages`` with ``text`` less its boilerplate lines, and n_lines and n_dropped.

    Input columns named n_lines or n_dropped are replaced.
    """
    names = [c for c in pages.columns if c.lower() not in ("n_lines", "n_dropped")]
    dropped = boilerplate_lines(pages, text=text, host=host, ratio=ratio, min_pages=min_pages, copies_once=copies_once)
    # materialised: its size decides the join
    from .util import cut

    by_host = cut(dropped.groupBy("_host").agg(F.collect_set("_line").alias("_drop"), F.count(F.lit(1)).alias("_n")))
    size = by_host.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    by_host = by_host.select(F.struct("_host").alias("_key"), "_drop")
    left = pages.select(*names, F.struct(F.col(host).alias("_host")).alias("_key"))
    if size <= broadcast_lines:
        joined = left.join(F.broadcast(by_host), "_key", "left")
    else:
        salt = F.array(*[F.lit(i) for i in range(salts)])
        spread = F.pmod(F.xxhash64(F.col(text), F.monotonically_increasing_id()), F.lit(salts)).cast("int")
        joined = left.withColumn("_salt", spread).join(by_host.withColumn("_salt", F.explode(salt)), ["_key", "_salt"], "left")
    # most pages hold none: only the others pay for the filter
    lines = F.split(F.col(text), "\n")
    keys = line_keys(F.col(text))
    joined = joined.withColumn("_bad", F.when(F.col("_drop").isNotNull() & F.col(text).isNotNull(), F.array_intersect(keys, F.col("_drop"))))
    joined = joined.withColumn("_kept", F.when(F.size("_bad") > 0, F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("_bad"), F.xxhash64(F.trim(x))), F.lit(False)) | (F.trim(x) == ""))))
    total = F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    new = F.when(F.col("_kept").isNotNull(), F.array_join("_kept", "\n")).otherwise(F.col(text))
    return joined.select(
        *[new.alias(c) if c == text else F.col(c) for c in names],
        total.alias("n_lines"),
        F.when(F.col("_kept").isNotNull(), total - F.size("_kept")).otherwise(F.lit(0)).cast("long").alias("n_dropped"),
    )
