"""Exact top-k inner products with a KD-tree in each shard.

Vectors become integers floor(scale * x). A bounded sample (``sample_rows``)
gives median splits of the widest dimensions, by which every row is sent to a
shard of about ``shard_rows``, a region of its own; a region of more than twice
as many rows (equal or crowded vectors) is cut into pieces by a hash. In each
shard a KD-tree is built once (splits at the median of the dimension of the
widest spread, tight bounding boxes at the leaves and around the shard) and
written: points with the number of their leaf, and the shard's box.

The bound of a query on a box is the sum over dimensions of max(q * low,
q * high). Every query first searches the shard of its best bound, whose k-th
score is propagated: it then goes to those shards only whose bound reaches it
(a bound equal to it counts, as a smaller id wins ties). Boxes are broadcast in
chunks of at most BOX_BYTES. In a shard all its queries, in blocks of about
``block_rows``, search best-first together: in round r every query visits the
leaf of its r-th best bound, and stops once that bound is below its k-th score
so far. Leaves visited in a round are scored as one product of matrices for
all their queries. No pair of rows is ever emitted, only (query, shard) pairs
that the bounds allow.

Scores are exact: with components below 2^b in size and d dimensions the
products run in float64 while d * 4^b < 2^53, in int64 while it is below 2^63,
else in Python's integers; a score beyond 64 bits counts as the nearest that
has them, as does a component.

Defined results: null vectors and vectors with a null or non-finite component
take no part, as queries or candidates, nor do rows with a null id; vectors of
different lengths never meet (a query sees the rows of its own length); rows
that repeat an id are each candidates, but not of the query rows of that id;
repeated query rows count once, while different vectors of one id are queries
of their own; fewer than k candidates give them all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .util import cut, discard

#: Below any score; its negative is an integer too.
FLOOR = -(1 << 63) + 1
#: What is broadcast of the shards' boxes at a time.
BOX_BYTES = 16 << 20


def quantise(vector: Column, scale: float = 64.0) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


class Tree:
    """Leaves of a KD-tree: row ranges of ``order`` and their tight boxes."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.order = np.arange(len(x))
        self.ranges: list[tuple[int, int]] = []
        todo = [(0, len(x))]
        while todo:
            a, b = todo.pop()
            rows = x[self.order[a:b]]
            spread = rows.max(axis=0) - rows.min(axis=0)
            dim = int(spread.argmax()) if rows.shape[1] else 0
            if b - a <= leaf or not spread.size or spread[dim] == 0:
                self.ranges.append((a, b))
                continue
            mid = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(rows[:, dim], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.low = np.stack([x[self.order[a:b]].min(axis=0) for a, b in self.ranges])
        self.high = np.stack([x[self.order[a:b]].max(axis=0) for a, b in self.ranges])

    @classmethod
    def of_leaves(cls, x: np.ndarray, leaf: np.ndarray) -> Tree:
        """A tree that was built before, by the leaf of each row."""
        self = cls.__new__(cls)
        self.order = np.argsort(leaf, kind="stable")
        edges = np.flatnonzero(np.concatenate([[True], np.diff(leaf[self.order]) != 0, [True]]))
        self.ranges = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        self.low = np.stack([x[self.order[a:b]].min(axis=0) for a, b in self.ranges])
        self.high = np.stack([x[self.order[a:b]].max(axis=0) for a, b in self.ranges])
        return self

    def bounds(self, q: np.ndarray) -> np.ndarray:
        return box_bounds(q, self.low, self.high)


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The greatest inner product of each query with a point of each box."""
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T


def exact_type(*arrays: np.ndarray):
    """The quickest type in which inner products of these rows are exact."""
    top = max([1, *(max(abs(int(a.min())), abs(int(a.max()))) for a in arrays if a.size)])
    most = max([1, *(a.shape[1] for a in arrays)]) * top * top
    return np.float64 if most < 1 << 53 else np.int64 if most < 1 << 63 else object


def _long(x: np.ndarray) -> np.ndarray:
    """As 64-bit scores, above FLOOR."""
    return (np.clip(x, FLOOR + 1, -FLOOR - 1) if x.dtype == object else x).astype(np.int64)


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, qids: np.ndarray, kth: np.ndarray, k: int, leaf: int = 256, leaves: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, row id, score) of each query's k best rows of a shard that can still count.

    ``kth``: a lower bound on each query's final k-th score. ``leaves``: the
    leaf of each row, where the tree was built before.
    """
    exact = exact_type(x, q)
    x, q = x.astype(exact), q.astype(exact)
    tree = Tree(x, leaf) if leaves is None else Tree.of_leaves(x, leaves)
    bound = _long(tree.bounds(q)) if exact is object else tree.bounds(q)
    order = np.argsort(-bound, axis=1, kind="stable")
    low = FLOOR
    best = np.full((len(q), k), low, dtype=np.int64)
    who = np.zeros((len(q), k), dtype=np.int64)
    kth = kth.copy()
    live = np.arange(len(q))
    for r in range(len(tree.ranges)):
        leaves = order[live, r]
        go = bound[live, leaves] >= kth[live]
        live, leaves = live[go], leaves[go]
        if not len(live):
            break
        for n in np.unique(leaves):
            mine = live[leaves == n]
            a, b = tree.ranges[n]
            rows = tree.order[a:b]
            s = _long(q[mine] @ x[rows].T)
            s[qids[mine][:, None] == ids[rows][None, :]] = low
            alls = np.concatenate([best[mine], s], axis=1)
            alli = np.concatenate([who[mine], np.broadcast_to(ids[rows], (len(mine), b - a))], axis=1)
            if alls.shape[1] > 4 * k:  # only what reaches the k-th score by value, ties kept
                cut_at = -np.partition(-alls, k - 1, axis=1)[:, k - 1]
                width = int((alls >= cut_at[:, None]).sum(axis=1).max())
                part = np.argpartition(-alls, min(width, alls.shape[1]) - 1, axis=1)[:, :width]
                alls, alli = np.take_along_axis(alls, part, 1), np.take_along_axis(alli, part, 1)
            keep = np.lexsort((alli, -alls), axis=1)[:, :k]
            best[mine] = np.take_along_axis(alls, keep, 1)
            who[mine] = np.take_along_axis(alli, keep, 1)
            kth[mine] = np.maximum(kth[mine], best[mine, k - 1])
    at, j = np.nonzero((best > low) & (best >= kth[:, None]))
    return at, who[at, j], best[at, j]


def region_splits(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(dimension, threshold) of the inner nodes of a tree of medians, in heap order; rows above the threshold go right."""
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.iinfo(np.int64).max)
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        if node >= len(dims) or len(rows) < 2:
            continue
        own = sample[rows]
        spread = own.max(axis=0).astype(float) - own.min(axis=0)
        dim = int(spread.argmax()) if spread.size else 0
        if not spread.size or not spread[dim]:
            continue
        value = np.sort(own[:, dim])
        at = value[(len(value) - 1) // 2]
        if at == value[-1]:  # more than half are the greatest: those go right
            at = value[value < at][-1]
        dims[node], cuts[node] = dim, at
        right = own[:, dim] > at
        todo += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return dims, cuts


def region_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    while len(dims) and len(node) and node[0] < len(dims):
        node = 2 * node + 1 + (x[np.arange(len(x)), dims[node]] > cuts[node])
    return node - len(dims)


def _matrix(col, rows: int, d: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).reshape(rows, d)


SHARD = ["dim", "shard", "piece"]


def build(rows: DataFrame, shard_rows: int, sample_rows: int, leaf: int = 256) -> DataFrame:
    """The written trees: dim, shard, piece, leaf, id and v; leaf -1 and -2 are the low and the high corner of the shard's box."""
    spark = rows.sparkSession
    splits = {}
    for d, n in rows.groupBy("dim").count().where(F.col("count") > shard_rows).collect():
        most = min(sample_rows, 256 * -(-n // shard_rows))
        got = rows.where(F.col("dim") == d).sample(min(1.0, 1.2 * most / n), 7).limit(most).select("v").toArrow()
        depth = max(0, min((max(1, got.num_rows) // 4).bit_length() - 1, (-(-n // shard_rows) - 1).bit_length()))
        if d and depth:
            splits[d] = region_splits(_matrix(got.column("v"), got.num_rows, d), depth)
    shared = spark.sparkContext.broadcast(splits)

    def place(batches):
        for b in batches:
            dim = b.column(0).to_numpy()
            shard = np.zeros(len(dim), np.int64)
            for d in np.unique(dim).tolist():
                if d in shared.value:
                    at = np.flatnonzero(dim == d)
                    shard[at] = region_of(_matrix(b.column(2).take(pa.array(at)), len(at), d), *shared.value[d])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard)], names=["dim", "id", "v", "shard"])

    placed = rows.select("dim", "id", "v").mapInArrow(place, "dim int, id long, v array<long>, shard long")
    crowded = cut(placed.groupBy("dim", "shard").count().where(F.col("count") > 2 * shard_rows).select("dim", "shard", F.ceil(F.col("count") / shard_rows).cast("int").alias("_n")))
    if crowded.limit(1).count():  # equal vectors too are spread, with their number in the task
        placed = placed.withColumn("_s", F.xxhash64("id", F.monotonically_increasing_id())).join(F.broadcast(crowded), ["dim", "shard"], "left")
        placed = placed.withColumn("piece", F.coalesce(F.pmod("_s", "_n").cast("int"), F.lit(0))).drop("_s", "_n")
    else:
        placed = placed.withColumn("piece", F.lit(0))

    def grow(t: pa.Table) -> pa.Table:
        d = t.column("dim")[0].as_py()
        x = _matrix(t.column("v"), t.num_rows, d)
        tree = Tree(x, leaf)
        number = np.zeros(t.num_rows, np.int32)
        for n, (a, b) in enumerate(tree.ranges):
            number[tree.order[a:b]] = n
        ends = [x.min(axis=0).tolist(), x.max(axis=0).tolist()]
        leaves = pa.concat_arrays([pa.array([-1, -2], pa.int32()), pa.array(number)])
        ids = pa.concat_arrays([pa.array([0, 0], pa.int64()), t.column("id").combine_chunks()])
        v = pa.concat_arrays([pa.array(ends, t.column("v").type), t.column("v").combine_chunks()])
        same = {c: pa.array([t.column(c)[0].as_py()] * len(ids), t.schema.field(c).type) for c in SHARD}
        return pa.table({**same, "leaf": leaves, "id": ids, "v": v})

    # a row on its own may be sampled or not: what is placed twice may differ, so it is written once, with its tree
    return cut(placed.select(*SHARD, "id", "v").groupBy(*SHARD).applyInArrow(grow, "dim int, shard long, piece int, leaf int, id long, v array<long>"))


def visits(asked: DataFrame, tree: DataFrame, best: bool) -> DataFrame:
    """(query, id, dim, shard, piece): the shard of each query's best bound, or all whose bound reaches its ``kth``.

    ``asked`` has query, id, dim, v and kth.
    """
    spark = asked.sparkSession
    boxes = tree.where("leaf < 0")
    # of two arrays a box; what one chunk holds is bounded
    size = boxes.agg(F.coalesce(F.sum(F.col("dim") * 8 + 32), F.lit(0))).first()[0]
    chunks = max(1, -(-size // BOX_BYTES))
    out = None
    for c in range(chunks):
        got: dict[int, list] = {}
        part = boxes if chunks == 1 else boxes.where(F.pmod(F.xxhash64(*SHARD), F.lit(chunks)) == c)
        for r in part.toLocalIterator():
            got.setdefault(r["dim"], []).append((r["shard"], r["piece"], -r["leaf"], r["v"]))
        packed = {}
        for d, rows in got.items():
            rows.sort(key=lambda r: r[:3])
            corner = np.array([r[3] for r in rows], dtype=np.int64).reshape(len(rows), d)
            packed[d] = np.array([r[0] for r in rows[::2]]), np.array([r[1] for r in rows[::2]], np.int32), corner[::2], corner[1::2]
        shared = spark.sparkContext.broadcast(packed)

        def run(batches, shared=shared):
            for b in batches:
                dims = b.column(2).to_numpy()
                for d in np.unique(dims).tolist():
                    if d not in shared.value:
                        continue
                    shard, piece, low, high = shared.value[d]
                    rows = np.flatnonzero(dims == d)
                    for p in range(0, len(rows), step := max(1, (1 << 20) // len(shard))):
                        at = rows[p : p + step]
                        q = _matrix(b.column(3).take(pa.array(at)), len(at), d)
                        exact = exact_type(q, low, high)
                        bound = box_bounds(q.astype(exact), low.astype(exact), high.astype(exact))
                        bound = _long(bound)
                        i, j = (np.arange(len(at)), bound.argmax(axis=1)) if best else np.nonzero(bound >= b.column(4).to_numpy()[at][:, None])
                        own = pa.array(at[i])
                        yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), b.column(2).take(own), pa.array(shard[j]), pa.array(piece[j]), pa.array(bound[i, j])], names=["query", "id", *SHARD, "bound"])

        pairs = asked.select("query", "id", "dim", "v", "kth").mapInArrow(run, "query long, id long, dim int, shard long, piece int, bound long")
        out = pairs if out is None else out.unionAll(pairs)
    if best and chunks > 1:
        out = out.withColumn("_r", F.row_number().over(W.partitionBy("query", "id").orderBy(F.desc("bound"), "shard", "piece"))).where("_r = 1").drop("_r")
    return out.drop("bound")


def _search_shards(pairs: DataFrame, asked: DataFrame, tree: DataFrame, k: int, block_rows: int) -> DataFrame:
    """query, query_id, vec_id and score of what the shards of ``pairs`` give their queries."""
    blocks = pairs.groupBy(*SHARD).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("_blocks"))
    keys = [*SHARD, "block"]
    left = pairs.join(asked.select("query", "id", "v", "kth"), ["query", "id"]).join(blocks, SHARD)
    left = left.withColumn("block", F.pmod(F.xxhash64("query", "id"), F.col("_blocks")).cast("int")).drop("_blocks")
    right = tree.where("leaf >= 0").join(blocks, SHARD).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")

    def both(q: pa.Table, x: pa.Table) -> pa.Table:
        if not q.num_rows or not x.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query", "query_id", "vec_id", "score")})
        d = q.column("dim")[0].as_py()
        qid, rid = q.column("id").to_numpy(), x.column("id").to_numpy()
        at, who, score = search(_matrix(x.column("v"), x.num_rows, d), rid, _matrix(q.column("v"), q.num_rows, d), qid, q.column("kth").to_numpy(), k, leaves=x.column("leaf").to_numpy())
        return pa.table({"query": q.column("query").to_numpy()[at], "query_id": qid[at], "vec_id": who, "score": score})

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(both, "query long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", k: int = 20, scale: float = 64.0, shard_rows: int = 16_384, block_rows: int = 4_096, sample_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best rows of ``vectors``, itself left out."""

    def prepared(df: DataFrame) -> DataFrame:
        ok = df.where(usable(F.col(vector)) & F.col(vec_id).isNotNull())
        return ok.select(F.col(vec_id).cast("long").alias("id"), quantise(F.col(vector), scale).alias("v")).withColumn("dim", F.size("v"))

    tree = build(prepared(vectors), shard_rows, sample_rows)
    asked = cut(prepared(queries).distinct().withColumn("query", F.xxhash64("id", "v")).withColumn("kth", F.lit(FLOOR)))
    home = cut(visits(asked, tree, best=True))
    near = cut(_search_shards(home, asked, tree, k, block_rows))
    order = W.partitionBy("query", "query_id").orderBy(F.col("score").desc(), "vec_id")
    # a query's k-th score in its first shard bounds the others; fewer than k rows bound nothing
    kth = near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") == k).select("query", F.col("query_id").alias("id"), F.col("score").alias("kth"))
    bounded = cut(asked.drop("kth").join(kth, ["query", "id"], "left").withColumn("kth", F.coalesce("kth", F.lit(FLOOR))))
    others = cut(visits(bounded, tree, best=False).join(home, ["query", "id", *SHARD], "left_anti"))
    found = near.unionAll(_search_shards(others, bounded, tree, k, block_rows)) if others.limit(1).count() else near
    discard(asked, home)
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
