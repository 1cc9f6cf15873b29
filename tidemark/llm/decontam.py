"""Benchmark decontamination by winnowing.

A *window* is ``window`` consecutive words of a benchmark item; an item of
fewer words (but at least one) is one window by itself. A document word is hit
when it lies inside any occurrence of a window.

Method: hash every k-gram of words, keep the minimum hash of each sliding run
of ``window - k + 1`` k-grams on both sides (winnowing: a shared span of
``window`` words always shares a kept fingerprint), join the fingerprints and
extend each joint fingerprint to the windows around it, compared by 64-bit
hashes of all their words. Windows shorter than ``k + 1`` words, which come
from short items only, use a k of their own length, where every k-gram is
kept.

A benchmark of up to ``broadcast_bytes`` of distinct text (measured first) is
joined on the map side: its fingerprints and windows are broadcast and one
pass over the documents needs no shuffle. A larger one is joined by shuffle:
items and documents each make their fingerprints once; those of documents that
aren't in a bitmap of fixed size (FILTER_BITS) of the benchmark's
fingerprints stay behind; the others meet the fingerprints by a join on (window
length, fingerprint), are extended to the windows around them, and those meet
the benchmark's windows by hash. Hits are merged by the hash of their text and
joined to the documents. So the documents are read twice and shuffled only
where hits are too many to broadcast, whatever the size of the benchmark, and
no item is ever collected.

Defined results: null or wordless text has no words and no hits; a null or
wordless item has no windows; items that share an id count as one item; items
whose id is null mark words but aren't listed; repeated documents are each
reported; input columns with the names of output columns are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
]
#: Bits of the filter before a map-side join, and of the one before a shuffle join (16 MB).
SMALL_FILTER_BITS, FILTER_BITS = 20, 27
#: Texts with hits up to which they are broadcast to the documents.
BROADCAST_TEXTS = 200_000


def winnow(gram: np.ndarray, valid: np.ndarray, w: int) -> np.ndarray:
    """Positions of k-grams that are the least of some run of ``w`` of them.

    Runs across document bounds hold invalid k-grams, which count as the
    greatest hash: they can only add positions.
    """
    g = np.where(valid, gram, np.uint64(0xFFFFFFFFFFFFFFFF))
    if w <= 1 or len(g) <= 1:
        return np.flatnonzero(valid)
    padded = np.concatenate([np.full(w - 1, ~np.uint64(0)), g, np.full(w - 1, ~np.uint64(0))])
    n = len(g) + w - 1
    least = padded[:n].copy()
    for j in range(1, w):
        np.minimum(least, padded[j : j + n], out=least)
    # position i lies in the runs i .. i + w - 1; it is kept if it equals any of their minima
    most = least[: len(g)].copy()
    for j in range(1, w):
        np.maximum(most, least[j : j + len(g)], out=most)
    return np.flatnonzero((g == most) & valid)


class Index:
    """Windows of a block of items, by window length."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int, k: int):
        self.names: list[str | None] = []
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        number: dict[str | None, int] = {}
        col = pa.array([t for _, t in items], type=pa.string())
        for i, j, words in textvec.word_chunks(col):
            for d in range(i, j):
                h = words.hash[words.offs[d - i] : words.offs[d - i + 1]]
                if not len(h):
                    continue
                name = items[d][0]
                if name not in number:
                    number[name] = len(self.names)
                    self.names.append(name)
                by_length.setdefault(min(window, len(h)), []).append((h, number[name]))
        self.parts = []
        for m, group in sorted(by_length.items()):
            kk = min(k, m)
            w = m - kk + 1
            keys = np.concatenate([textvec.grams(h, m) for h, _ in group])
            owner = np.concatenate([np.full(len(h) - m + 1, n) for h, n in group])
            prints = []
            for h, _ in group:
                g = textvec.grams(h, kk)
                prints.append(g[winnow(g, np.ones(len(g), bool), w)])
            pairs = np.unique(np.rec.fromarrays([keys, owner], names="key,owner"))
            uniq, first = np.unique(pairs.key, return_index=True)
            fp = np.unique(np.concatenate(prints))
            bits = np.zeros(1 << SMALL_FILTER_BITS, dtype=bool)
            bits[fp & np.uint64((1 << SMALL_FILTER_BITS) - 1)] = True
            self.parts.append((m, kk, w, fp, bits, uniq, np.append(first, len(pairs)), pairs.owner.copy()))


def _member(x: np.ndarray, sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(sorted_keys, x)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == x, at


def _grams(words: textvec.Words, k: int, known: dict) -> tuple[np.ndarray, np.ndarray]:
    if k not in known:
        g = textvec.grams(words.hash, k)
        known[k] = g, textvec.gram_valid(words.offs, k, len(g))
    return known[k]


def around(words: textvec.Words, at: np.ndarray, m: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows of ``m`` words that hold a fingerprint at ``at``, inside its document, and the documents."""
    start = np.unique((at[:, None] - np.arange(w)[None, :]).ravel())
    start = start[(start >= 0) & (start + m <= len(words.hash))]
    doc = np.searchsorted(words.offs, start, side="right") - 1
    inside = start + m <= words.offs[doc + 1]
    return start[inside], doc[inside]


def window_hashes(words: textvec.Words, start: np.ndarray, m: int) -> np.ndarray:
    h = words.hash[start].copy()
    for j in range(1, m):
        h *= np.uint64(textvec._MUL)
        h += words.hash[start + j]
    return textvec.mix(h)


def scan(words: textvec.Words, index: Index) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Hit words of a chunk (a mask) and ``(document, item number)`` pairs."""
    n = len(words.hash)
    mark = np.zeros(n + 1, dtype=np.int32)
    found: set[tuple[int, int]] = set()
    by_k: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for m, k, w, fp, bits, keys, first, owner in index.parts:
        if n < m:
            continue
        gram, valid = _grams(words, k, by_k)
        at = winnow(gram, valid, w)
        at = at[bits[gram[at] & np.uint64((1 << SMALL_FILTER_BITS) - 1)]]
        at = at[_member(gram[at], fp)[0]]
        if not len(at):
            continue
        start, doc = around(words, at, m, w)
        if not len(start):
            continue
        h = gram[start] if k == m else window_hashes(words, start, m)
        hit, pos = _member(h, keys)
        start, doc, pos = start[hit], doc[hit], pos[hit]
        np.add.at(mark, start, 1)
        np.add.at(mark, start + m, -1)
        for d, p in set(zip(doc.tolist(), pos.tolist())):
            found.update((d, int(o)) for o in owner[first[p] : first[p + 1]])
    return np.cumsum(mark[:-1]) > 0, list(found)


def _pass(docs: DataFrame, text: str, index) -> DataFrame:
    def compute(batch: pa.RecordBatch) -> list:
        ix: Index = index.value
        n_words, n_hit, spans, ids = [], [], [], []
        for i, j, words in textvec.word_chunks(textvec.text_column(batch, text)):
            hit, found = scan(words, ix)
            total = np.concatenate([[0], np.cumsum(hit)])
            n_words.append(np.diff(words.offs))
            n_hit.append(np.diff(total[words.offs]))
            own: list[list | None] = [[] for _ in range(j - i)]
            names: list[set[str]] = [set() for _ in range(j - i)]
            for d, o in found:
                if ix.names[o] is not None:
                    names[d].add(ix.names[o])
            for d in np.flatnonzero(n_hit[-1]):
                x = hit[words.offs[d] : words.offs[d + 1]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], x.astype(np.int8), [0]])))
                own[d] = [{"first": int(a), "last": int(b) - 1} for a, b in edge.reshape(-1, 2)]
            spans += own
            ids += [sorted(s) for s in names]
        whole = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0), type=pa.int64())
        return [whole(n_words), whole(n_hit), spans, ids]

    return util.with_columns(docs, FIELDS, compute)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _item_windows(items: DataFrame, window: int, k: int) -> DataFrame:
    """(m, print, key, id) of the items' windows, and of their fingerprints with null key and id."""

    def run(batches):
        for b in batches:
            for i, j, words in textvec.word_chunks(b.column(1)):
                known: dict = {}
                sizes = np.diff(words.offs)
                for m in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
                    kk = min(k, m)
                    of = np.flatnonzero(np.minimum(sizes, window) == m)
                    gram, valid = _grams(words, kk, known)
                    owner = np.repeat(np.arange(j - i), sizes)
                    at = winnow(gram, valid, m - kk + 1)
                    fp = np.unique(gram[at[np.isin(owner[at], of)]])
                    n = len(words.hash) - m + 1
                    start = np.flatnonzero(textvec.gram_valid(words.offs, m, n) & np.isin(owner[:n], of))
                    key = gram[start] if kk == m else window_hashes(words, start, m)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), m, np.int32)), _signed(fp), pa.nulls(len(fp), pa.int64()), pa.nulls(len(fp), pa.string())], names=["m", "print", "key", "id"])
                    ids = b.column(0).slice(i, j - i).take(pa.array(owner[start]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), m, np.int32)), pa.nulls(len(start), pa.int64()), _signed(key), ids], names=["m", "print", "key", "id"])

    return items.mapInArrow(run, "m int, print long, key long, id string")


def _bitmap(prints: DataFrame) -> np.ndarray:
    """The fingerprints' low FILTER_BITS as a packed bitmap, made in pieces of 2^20 bits: its size is fixed."""
    piece = 1 << 20
    slots = prints.select(F.col("print").bitwiseAND(F.lit((1 << FILTER_BITS) - 1)).alias("slot")).distinct()
    out = np.zeros(1 << (FILTER_BITS - 3), dtype=np.uint8)

    def pack(table: pa.Table) -> pa.Table:
        slot = table.column("slot").to_numpy()
        bits = np.zeros(piece, dtype=bool)
        bits[slot & (piece - 1)] = True
        return pa.table({"at": pa.array([int(slot[0]) >> 20], pa.int64()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    for r in slots.groupBy(F.shiftright("slot", 20).alias("_at")).applyInArrow(pack, "at long, bits binary").toLocalIterator():
        out[r["at"] << 17 : (r["at"] + 1) << 17] = np.frombuffer(r["bits"], np.uint8)
    return out


TEXT_KEY = ("_h0", "_h1")


def _text_key(text: str) -> list:
    return [F.xxhash64(text).alias("_h0"), F.xxhash64(F.lit(1), text).alias("_h1")]


def _document_prints(docs: DataFrame, lengths: list[int], k: int, bitmap) -> DataFrame:
    """(text key, m, print, first, keys): fingerprints in the bitmap, and the hashes of the windows around each, from word ``first`` on."""

    def run(batches):
        bits = bitmap.value
        for b in batches:
            for i, j, words in textvec.word_chunks(b.column(2)):
                known: dict = {}
                for m in lengths:
                    if len(words.hash) < m:
                        continue
                    kk = min(k, m)
                    w = m - kk + 1
                    gram, valid = _grams(words, kk, known)
                    at = winnow(gram, valid, w)
                    slot = (gram[at] & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)
                    at = at[(bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1]
                    for p in range(0, len(at), 1 << 14):
                        part = at[p : p + (1 << 14)]
                        start, _ = around(words, part, m, w)
                        key = gram[start] if kk == m else window_hashes(words, start, m)
                        doc = np.searchsorted(words.offs, part, side="right") - 1
                        lo = np.searchsorted(start, np.maximum(part - w + 1, words.offs[doc]))
                        hi = np.searchsorted(start, part, side="right")
                        n = np.maximum(hi - lo, 0)
                        take = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                        keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), _signed(key[take]))
                        first = np.where(n > 0, start[np.minimum(lo, max(0, len(start) - 1))] if len(start) else 0, 0) - words.offs[doc]
                        own = pa.array(doc + i)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(np.full(len(part), m, np.int32)), _signed(gram[part]), pa.array(first.astype(np.int32)), keys], names=[*TEXT_KEY, "m", "print", "first", "keys"])

    return docs.mapInArrow(run, "_h0 long, _h1 long, m int, print long, first int, keys array<long>")


def _joined(docs: DataFrame, items: DataFrame, text: str, window: int, k: int) -> DataFrame:
    """(text key, hit_spans, item_ids) of the texts with hits, by shuffle joins."""
    spark = docs.sparkSession
    made = util.cut(_item_windows(items, window, k))
    prints = util.cut(made.where("key is null").select("m", "print").distinct())
    windows = util.cut(made.where("key is not null").select("m", "key", "id").distinct())
    util.discard(made)
    lengths = sorted(r.m for r in prints.select("m").distinct().collect())
    found = _document_prints(docs.select(*_text_key(text), F.col(text).alias("text")), lengths, k, spark.sparkContext.broadcast(_bitmap(prints)))
    near = found.join(prints, ["m", "print"], "left_semi").select(*TEXT_KEY, "m", F.posexplode("keys").alias("_i", "key"), "first")
    near = near.select(*TEXT_KEY, "m", "key", (F.col("first") + F.col("_i")).alias("start")).distinct()
    hits = util.cut(near.join(windows.select("m", "key").distinct(), ["m", "key"], "left_semi"))
    ids = hits.select(*TEXT_KEY, "m", "key").distinct().join(windows.where("id is not null"), ["m", "key"]).select(*TEXT_KEY, "id").distinct()
    ids = ids.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_list("id")).alias("_ids"))
    # union of the windows: one begins a span where all before it have ended
    order = W.partitionBy(*TEXT_KEY).orderBy("start", "m")
    ends = F.max(F.col("start") + F.col("m")).over(order.rowsBetween(W.unboundedPreceding, -1))
    spans = hits.withColumn("_new", (F.col("start") > F.coalesce(ends, F.lit(-1))).cast("int")).withColumn("_span", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    spans = spans.groupBy(*TEXT_KEY, "_span").agg(F.min("start").alias("first"), (F.max(F.col("start") + F.col("m")) - 1).alias("last"))
    spans = spans.groupBy(*TEXT_KEY).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("_spans"), F.sum(F.col("last") - F.col("first") + 1).alias("_hit"))
    out = util.cut(spans.join(ids, list(TEXT_KEY), "left"))
    util.discard(prints, windows, hits)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, k: int = 5, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, hit_spans (word numbers, inclusive) and item_ids."""
    if not 1 <= k <= window:
        raise ValueError("k must lie between 1 and window")
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull())
    size = F.coalesce(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("id"), F.lit(0)) + 16), F.lit(0))
    if items.agg(size).first()[0] > broadcast_bytes:  # perhaps only for rows that repeat
        items = util.cut(items.distinct())
        if items.agg(size).first()[0] > broadcast_bytes:
            hits = _joined(docs, items, text, window, k)
            few = F.broadcast(hits) if hits.count() <= BROADCAST_TEXTS else hits
            none = _pass(docs, text, spark.sparkContext.broadcast(Index([], window, k)))
            names = none.columns
            rows = none.select("*", *_text_key(text)).join(few, list(TEXT_KEY), "left")
            merged = {"n_hit": F.coalesce("_hit", F.lit(0)).cast("long"), "hit_spans": F.coalesce("_spans", "hit_spans"), "item_ids": F.coalesce("_ids", "item_ids")}
            return rows.select(*[merged[c].alias(c) if c in merged else c for c in names])
    rows = [(r.id, r.text) for r in items.collect()]
    return _pass(docs, text, spark.sparkContext.broadcast(Index(rows, window, k)))
