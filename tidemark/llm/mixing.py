"""Mixing sources to target weights with a low-discrepancy schedule.

Target of a source: its share of all words by weight, but at most
``max_epochs`` times its own words; what is cut is shared again by weight
among the others until none is above (closed form: sources sorted by cap over
weight; a prefix of them is capped).

Method: a source's documents, shuffled by md5 of the id, lie end to end and
are cut into equal blocks (to a word) of at most ``block`` words. A source
needs as many slots as cover its rounded target with blocks. The mix is a
sequence of slots: slot i takes the point (i * g mod 2^31) / 2^31, g / 2^31
being close to the golden ratio's inverse, and maps it through the cumulative
numbers of slots to a source. The slots of a source are ranked; the r-th takes
block r mod n of the source's n blocks, the last one only the words that the
target leaves. The sequence keeps each source's number of slots within a few
of its share however the sources are ordered; the few slots that a source
then lacks come at the end. Slots and documents meet by a join on (source,
block); a document's ``taken`` is the sum over the slots of its words in them.
So each source's taken words are its rounded target.

Scale: everything up to the last join works on slim rows (source number, key,
size), written once, and the texts are counted once. Ranks and running word
counts of a source are sums over ranges first and windows inside a range
second, so that a hot source is many tasks. There are about a thousand slots a
source on average, however many words it has. The documents themselves are
shuffled once, to meet their ``taken``.

Defined results: null text has size 0 and takes 0 words; null sources form one
source, last in order; no words at all: targets 0, nothing taken; a source
without words has target 0; documents with one id lie in the order of a hash
of their text, and equal rows one after the other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.scan import index_rows

from .util import cut, discard

GOLDEN = 1327217885  # odd, about 2^31 / golden ratio
PERIOD = 1 << 31
CELLS = 1 << 10
#: Rows of the source and bucket tables up to which they are broadcast; beyond, they are joined by hash.
BROADCAST_ROWS = 100_000


def size_of(text: Column) -> Column:
    """Number of runs of other than space and 0x09-0x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3) -> DataFrame:
    """(source, source_size, n_docs) with its number k, weight, target and the total.

    One row a source; the windows run over source rows only.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k"), F.lit(len(weights))) + 1).cast("int"))
    s = sources.withColumn("k", (F.row_number().over(order) - 1).cast("long"))
    s = s.withColumn("weight", w.cast("long")).withColumn("cap", F.col("source_size") * max_epochs)
    by_ratio = W.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    s = (
        s.withColumn("total", F.sum("source_size").over(whole))
        .withColumn("weights", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0)))
        .withColumn("capped", F.col("weight") * (F.col("total") - F.col("cap_before")) >= F.col("cap") * (F.col("weights") - F.col("weight_before")))
    )
    s = s.withColumn("left", F.col("total") - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(whole)).withColumn("shared", F.sum(F.when(~F.col("capped"), F.col("weight")).otherwise(0)).over(whole))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise((F.col("weight") * F.col("left")).cast("double") / F.col("shared").cast("double"))
    return s.withColumn("target", target).select("source", "k", "source_size", "n_docs", "weight", "total", "target")


def cut_blocks(sources: DataFrame, block: int, max_epochs: int) -> DataFrame:
    """``sources`` with want (the rounded target), n (blocks), slots, and the half-open share [lo, hi) of [0, 2^31) by slots.

    Of a source's n blocks the first ``more`` have ``least`` + 1 words, the others ``least``.
    """
    s = sources.withColumn("want", F.least(F.round("target").cast("long"), F.col("source_size") * max_epochs))
    s = s.withColumn("n", F.greatest(F.lit(1), F.expr(f"(source_size + {block - 1}) div {block}")))
    s = s.withColumn("least", F.expr("source_size div n")).withColumn("more", F.expr("source_size % n")).withColumn("over", F.expr("want % greatest(source_size, 1)"))
    # whole epochs, then the blocks that begin before the rest ends
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.expr("want div source_size") * F.col("n") + F.when(F.col("over") > 0, _block_of(F.col("over") - 1) + 1).otherwise(0)).otherwise(0))
    by, every = W.orderBy("k"), W.partitionBy()
    hi = F.round(F.sum("slots").over(by.rowsBetween(W.unboundedPreceding, 0)) / F.greatest(F.lit(1), F.sum("slots").over(every)) * PERIOD).cast("long")
    return s.withColumn("hi", hi).withColumn("lo", F.coalesce(F.lag("hi").over(by), F.lit(0)))


def _block_of(at: Column) -> Column:
    """The block of a word of a source; ``least`` is 1 at least where there is a word."""
    wide = F.col("more") * (F.col("least") + 1)
    return F.when(at < wide, F.call_function("div", at, F.col("least") + 1)).otherwise(F.col("more") + F.call_function("div", at - wide, F.greatest("least", F.lit(1))))


def _start_of(block: Column) -> Column:
    """The first word of a block."""
    return block * F.col("least") + F.least(block, F.col("more"))


def schedule(spark: SparkSession, shared: DataFrame, slots: int) -> DataFrame:
    """(slot, k, rank): the source of each of the first ``slots`` slots, and the slot's rank in its source.

    A point finds its source through a grid of cells (an equi-join), then by
    the exact bounds.
    """
    wide = PERIOD // CELLS
    grid = shared.where("hi > lo").withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {wide}"), F.expr(f"(hi - 1) div {wide}"))))
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod(F.col("id"), F.lit(PERIOD)) * F.lit(GOLDEN), F.lit(PERIOD)).alias("p"))
    placed = points.withColumn("cell", F.expr(f"p div {wide}")).join(grid.select("cell", "k", "lo", "hi"), "cell").where("p >= lo and p < hi").select("slot", "k")
    return index_rows(placed, F.col("k"), F.col("slot")).select("slot", "k", F.col("_index").alias("rank"))


def slots_of(spark: SparkSession, sources: DataFrame, slots: int) -> DataFrame:
    """The mix: slot, k, epoch, block, first and upto (words of the source), one row a slot.

    ``sources`` are those of ``cut_blocks``, ``slots`` the sum of theirs.
    """
    drawn = cut(schedule(spark, sources.select("k", "lo", "hi"), slots))
    lack = sources.select("k", "slots").join(drawn.groupBy("k").agg(F.count(F.lit(1)).alias("got")), "k", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    lack = lack.where("got < slots").select((F.lit(slots) + F.col("k")).alias("slot"), "k", F.explode(F.sequence("got", F.col("slots") - 1)).alias("rank"))
    every = drawn.unionAll(lack).join(sources.select("k", "slots", "n", "least", "more", "want", "source_size"), "k").where("rank < slots")
    every = every.withColumn("epoch", F.expr("rank div n")).withColumn("block", F.expr("rank % n"))
    first, end = _start_of(F.col("block")), _start_of(F.col("block") + 1)
    return every.select("slot", "k", "epoch", "block", first.alias("first"), F.least(end, F.col("want") - F.col("epoch") * F.col("source_size")).alias("upto"))


def mix_sources(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, block: int | None = None, bucket_docs: int = 4_000) -> DataFrame:
    """The rows of ``docs`` with size, source_size, target and taken.

    ``block``: words a slot at most; by default a thousandth of the average
    source, 16 at least. Input columns with output names are replaced.
    """
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "taken"}]
    row = F.struct(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("key"), F.xxhash64(F.col(text)).alias("tie"))
    slim = cut(docs.select(F.struct(F.col(source).alias("s")).alias("_source"), row.alias("_row"), size_of(F.col(text)).alias("size")))
    per_source = slim.groupBy(F.col("_source.s").alias("source")).agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    aimed = cut(targets(per_source, weights, max_epochs))
    total, count, n_docs = aimed.agg(F.coalesce(F.max("total"), F.lit(0)), F.count(F.lit(1)), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    sources = cut(cut_blocks(aimed, block or max(16, total // max(1, 1000 * count)), max_epochs))
    n_slots = sources.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]

    def small(df: DataFrame, rows: int) -> DataFrame:
        return F.broadcast(df) if rows <= BROADCAST_ROWS else df

    # documents: their place in the shuffled source
    numbered = slim.join(small(sources.select(F.struct(F.col("source").alias("s")).alias("_source"), "k", "n_docs"), count), "_source")
    buckets = F.greatest(F.lit(1), F.expr(f"(n_docs + {bucket_docs - 1}) div {bucket_docs}"))
    unit = F.conv(F.substring("_row.key", 1, 8), 16, 10).cast("long")
    numbered = numbered.select("k", F.shiftright(unit * buckets, 32).alias("bucket"), "_row", "size")
    sums = numbered.groupBy("k", "bucket").agg(F.sum("size").alias("_n"))
    before = W.partitionBy("k").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select("k", "bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy("k", "bucket").orderBy("_row")
    placed = numbered.withColumn("_at", F.coalesce(F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    placed = placed.withColumn("copy", F.row_number().over(W.partitionBy("k", "bucket", "_row").orderBy("_at")))
    placed = placed.join(small(bases, count + n_docs // bucket_docs), ["k", "bucket"]).withColumn("at", F.col("_at") + F.col("_base"))

    # slots and documents meet on (source, block)
    times = slots_of(spark, small(sources, count), n_slots).groupBy("k", "block", "first", "upto").agg(F.count(F.lit(1)).alias("times"))
    lengths = small(sources.select("k", "least", "more"), count)
    parts = placed.where("size > 0").join(lengths, "k").withColumn("block", F.explode(F.sequence(_block_of(F.col("at")), _block_of(F.col("at") + F.col("size") - 1))))
    words = F.greatest(F.lit(0), F.least(F.col("at") + F.col("size"), F.col("upto")) - F.greatest("at", "first"))
    met = parts.select("k", "_row", "copy", "at", "size", "block").join(times, ["k", "block"], "left")
    met = met.groupBy("k", "_row", "copy").agg(F.sum(words * F.coalesce("times", F.lit(0))).cast("long").alias("taken"), F.first("size").alias("size"))
    taken = cut(met)

    sized = docs.select(*names, F.struct(F.col(source).alias("s")).alias("_source"), row.alias("_row"))
    sized = sized.join(small(sources.select(F.struct(F.col("source").alias("s")).alias("_source"), "k", "source_size", "target"), count), "_source")
    # rows repeated as a whole are numbered; mostly there are none, and no window is needed
    repeated = taken.where("copy > 1").limit(1).count() > 0
    sized = sized.withColumn("copy", F.row_number().over(W.partitionBy("k", "_row").orderBy(F.lit(0))) if repeated else F.lit(1))
    discard(slim, aimed)
    return sized.join(taken, ["k", "_row", "copy"], "left").select(*names, F.coalesce("size", F.lit(0)).cast("long").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
