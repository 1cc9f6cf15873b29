"""SimHash near-duplicates with an LSH forest.

Two documents are near-duplicates when the Jaccard similarity of their sets of
five-word shingles is at least 0.8 (a document of one to four words is one
shingle). Classes are the connected components of that relation; exact copies
(equal word sequences) are collapsed to one text before any pairing, so a
group of copies, however large, costs one aggregate.

Method: each distinct text has a 128-bit SimHash. An LSH forest of tries over
randomly permuted bits holds all texts. So that a text isn't shuffled once a
trie, the tries come in groups that share their first ``prefix`` bits: a text
is sent once a group, to the task of its prefix, and the group's tries over
permutations of the other bits are built there in memory. Inside a trie the
prefix adapts to the density: where a subtree of a shorter prefix (up to CLIMB
bits less) holds no more than ``leaf`` texts, the search climbs to it;
elsewhere it climbs to ``depth`` bits, the longest prefix that keeps the
target recall. ``shape`` takes the cheapest numbers of groups and tries whose
recall for a pair exactly at the similarity is ``recall``. Candidates pass a
bound on the Hamming distance and on the sizes of the sets, then one on their
parities: a bitmap that holds of each bucket of a set's hashes whether their
number is odd. The bits in which two bitmaps differ are never more than the
shingles in which the sets do, so this rules out most pairs below the
similarity and none at or above it. The rest are verified on their whole
shingle sets.

In round one the texts of a subtree are in order of their sizes, and each is
held against those before it whose size can reach the similarity: a small part
of the subtree, as sizes spread widely, and no link less.

Dense subtrees don't emit all their pairs. In round one a text that has more
than FEW candidates before it in a subtree is paired with the nearest of its
group only, and the texts of the pairs left out are marked. Round two sends the marked
texts through the same forest with the classes that round one left them in,
and takes all candidate pairs between different classes, in batches of bounded
size. There the texts carry their parities (of at most PARITY_BITS, longer ones
folded), so that n near-copies below the similarity of each other are compared
where they are and don't leave n squared pairs to verify. Fewer texts only shorten the prefixes, so each pair left out is met
again, and no candidate link between two classes goes untested, while n
near-copies cost n pairs at most in each group of tries.

A group of more than ``hot`` texts (a third of all texts may be near-copies of
one): round one, which only saves pairs, goes over it in order of the
signatures, a bounded piece after the other, and marks every text. Round two
takes it whole: its texts are cut into pieces by a hash, and those outside
the group's commonest class go to all pieces, so that all pairs between
classes are met and a task holds one piece. Subtrees of more than ``dense``
texts look in round one at WINDOW texts before each and mark all.

Defined results: null and wordless texts are copies of each other and form one
class; repeated ids or rows count as copies if their texts are equal; the kept
document of a class has the smallest id (null last). Ids may be of any type
with an order. Texts are identified by 64-bit hashes of their words in the
link graph. A text of any length is one row of one task, which holds about
fifteen bytes a byte of it.
"""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec
from .components import components
from .util import cut, discard

BITS = 128
KEY_BITS = 32
CLIMB = 3
SHINGLE = 5
BROADCAST_TEXTS = 2_000_000
BROADCAST_GROUPS = 100_000
#: Bits by which texts are shared out among tasks, where there are enough.
PREFIX = 4
#: What sending a text to one more group costs, in tries.
ROW_COST = 40
#: In a dense subtree a text looks for its nearest neighbour among so many before it in key order.
WINDOW = 256
#: Candidates before a text in a subtree up to which round one emits them all.
FEW = 2
BATCH_PAIRS = 1 << 18
#: Round one takes subtrees together up to so many rows, and looks at so many pairs at a time.
BATCH_ROWS, BATCH_LOOKS = 1 << 16, 1 << 16
#: The most bits of its parities that a text takes to round two.
PARITY_BITS = 1024
#: Sets of so few shingles are bounded by their exact bit difference; beyond, ties are rare enough.
SMALL_SHINGLES = 5


def _sequence_hash(h: np.ndarray, offs: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of the word sequence of each document."""
    mul = (0xD1342543DE82EF95 ^ (salt << 3)) | 1
    out = np.zeros(len(offs) - 1, dtype=np.uint64)
    step = 1 << 20
    for p in range(0, len(h), step):  # a longer run is one document's, or nearly so
        x = h[p : p + step]
        acc = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(x * textvec._powers(len(x), mul), out=acc[1:])
        first = max(0, int(np.searchsorted(offs, p, side="right")) - 1)
        last = int(np.searchsorted(offs, p + len(x), side="left"))
        a, b = np.clip(offs[first:last], p, None) - p, np.clip(offs[first + 1 : last + 1], None, p + len(x)) - p
        part = (acc[b] - acc[a]) * textvec._powers(len(x) + 1, pow(mul, -1, 1 << 64))[a]
        if last > first and offs[first] < p:
            part[:1] *= np.uint64(pow(mul, int(p - offs[first]), 1 << 64))
        out[first:last] += part
    return textvec.mix(out + np.diff(offs).astype(np.uint64))


def shingle_sets(words: textvec.Words, whole: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 48-bit shingle hashes, by document: (hashes, len + 1 offsets)."""
    docs = len(words.offs) - 1  # at most textvec.CHUNK_DOCS, which leaves their numbers 16 bits
    size = np.diff(words.offs)
    g = textvec.grams(words.hash, k)
    if docs > 1:
        g = g[textvec.gram_valid(words.offs, k, len(g))]
    g >>= np.uint64(16)
    if docs > 1:
        g |= np.repeat(np.arange(docs, dtype=np.uint64) << np.uint64(48), np.maximum(size - k + 1, 0))
    few = np.flatnonzero((size > 0) & (size < k)).astype(np.uint64)
    keys = np.concatenate([g, (few << np.uint64(48)) | (whole[few.astype(np.int64)] >> np.uint64(16))]) if len(few) else g
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
    offs = np.searchsorted(keys, np.arange(docs + 1, dtype=np.uint64) << np.uint64(48))
    return keys & np.uint64((1 << 48) - 1), offs


def signatures(shingles: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(documents, 2) uint64 SimHash words of sets of shingles; 0 for empty sets."""
    docs = len(offs) - 1
    out = np.zeros((docs, 2), dtype=np.uint64)
    some = np.flatnonzero(np.diff(offs) > 0)
    step = 1 << 16
    counts = np.zeros((docs, BITS), dtype=np.int64)
    for a in range(0, len(shingles), step):
        h = shingles[a : a + step]
        wide = np.empty((len(h), 2), dtype=np.uint64)
        wide[:, 0] = textvec.mix(h * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
        wide[:, 1] = textvec.mix(h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(7))
        bits = np.unpackbits(wide.view(np.uint8), axis=1)
        first = int(np.searchsorted(offs, a, side="right")) - 1
        last = int(np.searchsorted(offs, a + len(h), side="left"))
        cuts = np.clip(offs[first:last] - a, 0, len(h))
        full = np.flatnonzero(np.diff(np.append(cuts, len(h))) > 0)
        for lo in range(0, BITS, 64):
            counts[first + full, lo : lo + 64] += np.add.reduceat(bits[:, lo : lo + 64], cuts[full], axis=0, dtype=np.int32)
    sign = counts[some] * 2 > np.diff(offs)[some][:, None]
    out[some] = np.packbits(sign, axis=1).view(np.uint64)
    return out


def parities(shingles: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the parities of its buckets, two to four buckets a shingle: (uint64 words, len + 1 offsets).

    The buckets are low bits of the hashes and a power of two in number, so
    that xor of the halves makes the parities of half as many.
    """
    n = np.diff(offs)
    bits = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(2 * n, 1)))).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    odd = np.zeros(int(start[-1]), dtype=np.uint8)
    step = 1 << 20
    for a in range(0, len(shingles), step):
        h = shingles[a : a + step]
        of = np.searchsorted(offs, np.arange(a, a + len(h)), side="right") - 1
        np.add.at(odd, start[of] + (h & (bits[of] - 1).astype(np.uint64)).astype(np.int64), 1)
    return np.packbits(odd & 1, bitorder="little").view(np.uint64), start >> 6


def fold(words: np.ndarray, offs: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) parities of the chosen sets, each of ``width`` words or a power of two times that."""
    at, times = offs[rows], (offs[rows + 1] - offs[rows]) // width
    out = words[at[:, None] + np.arange(width)]
    for k in range(1, int(times.max(initial=1))):
        more = np.flatnonzero(times > k)
        out[more] ^= words[(at[more] + k * width)[:, None] + np.arange(width)]
    return out


def can_link(words: np.ndarray, offs: np.ndarray, size: np.ndarray, p: np.ndarray, q: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs (p, q) of sets may reach the similarity: False only where the parities exclude it."""
    most = np.floor((size[p] + size[q]) * (1 - similarity) / (1 + similarity) + 1e-6)  # shingles of one set only
    width = np.minimum(offs[p + 1] - offs[p], offs[q + 1] - offs[q])
    ok = np.ones(len(p), dtype=bool)
    for w in np.unique(width).tolist():
        at = np.flatnonzero(width == w)
        step = max(1, (1 << 20) // w)
        for a in range(0, len(at), step):
            r = at[a : a + step]
            ok[r] = np.bitwise_count(fold(words, offs, p[r], w) ^ fold(words, offs, q[r], w)).sum(axis=1) <= most[r]
    return ok


def _binary(words: np.ndarray, offs: np.ndarray) -> pa.Array:
    at = np.ascontiguousarray(offs * 8, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offs) - 1, [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(words))])


def _parity_words(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words and the lengths of a binary column without nulls."""
    col = col.cast(pa.large_binary())
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]].copy().view(np.uint64), np.diff(offs) >> 3


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


SIG = "text_key long, node long, n_shingles long, s0 long, s1 long"


def sketch(docs: DataFrame, text: str) -> DataFrame:
    """One row a document: its id, the hash of its words and its SimHash."""
    slim = docs.select("doc_id", F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))

    def run(batches):
        for b in batches:
            parts = []
            for i, j, words in textvec.word_chunks(textvec.text_column(b, "text")):
                whole = _sequence_hash(words.hash, words.offs, 1)
                sh, offs = shingle_sets(words, whole)
                sig = signatures(sh, offs)
                parts.append((whole, np.diff(offs), sig[:, 0], sig[:, 1]))
            if parts:
                cols = [np.concatenate(x) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), _signed(cols[0]), pa.array(cols[1].astype(np.int64)), _signed(cols[2]), _signed(cols[3])],
                    names=["doc_id", "text_key", "node", "n_shingles", "s0", "s1"],
                )

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], *T._parse_datatype_string(SIG).fields]))


@dataclass(frozen=True)
class Shape:
    """A forest: ``groups`` shuffled prefixes of ``prefix`` bits, each with ``tries`` tries of up to ``depth`` more bits."""

    prefix: int
    groups: int
    depth: int
    tries: int
    leaf: int
    bound: int
    small_bound: int
    similarity: float
    seed: int = 20

    def orders(self) -> list[tuple[np.ndarray, list[np.ndarray]]]:
        """Of each group the bits of its prefix, and of each of its tries the bits of its keys."""
        out = []
        for g in range(self.groups):
            rng = np.random.default_rng((self.seed, g))
            bits = rng.permutation(BITS)
            out.append((bits[: self.prefix], [rng.permutation(bits[self.prefix :])[:KEY_BITS] for _ in range(self.tries)]))
        return out


@functools.lru_cache
def bit_differences(similarity: float, most: int = 24) -> tuple[float, float]:
    """The largest chance that a bit of two sets at the similarity differs: over all sets, and over those of more than SMALL_SHINGLES.

    For large sets it is acos(2s / (1 + s)) / pi; small sets differ more often
    as ties count as 0, and are counted out exactly.
    """
    large = math.acos(2 * similarity / (1 + similarity)) / math.pi
    chance = lambda n, k: math.comb(n, k) / 2**n
    every = rest = large
    for shared in range(1, most):
        other = int(shared / similarity - shared + 1e-9)
        for a in range(other // 2 + 1):
            b = other - a
            p = 0.0
            for k in range(shared + 1):
                x = sum(chance(a, e) for e in range(a + 1) if 2 * (k + e) > shared + a)
                y = sum(chance(b, e) for e in range(b + 1) if 2 * (k + e) > shared + b)
                p += chance(shared, k) * (x * (1 - y) + y * (1 - x))
            every = max(every, p)
            if shared + b > SMALL_SHINGLES:
                rest = max(rest, p)
    return every, rest


def _bound(differ: float) -> int:
    return math.ceil(BITS * differ + 3.3 * math.sqrt(BITS * differ * (1 - differ)))


def shape(texts: int, similarity: float, recall: float, leaf: int, capacity: int) -> Shape:
    """The forest for this many texts: the cheapest whose recall at the similarity is ``recall``.

    A prefix is as long as brings the texts of a group down to ``capacity``,
    and of PREFIX bits at least where there are texts enough to share out. A
    pair is found if some group has both texts and one of its tries too; the
    chance is taken over the binomial spread of the bits that differ.
    """
    worst, differ = bit_differences(similarity)
    prefix = max(0, min(PREFIX, int(math.log2(texts / leaf)) if texts > leaf else 0), math.ceil(math.log2(texts / capacity)) if texts > capacity else 0)
    share = texts / 2**prefix
    depth = min(KEY_BITS, int(math.log2(share / leaf)) if share > leaf else 0)
    agree = lambda h, n, k: math.comb(n - h, k) / math.comb(n, k) if n - h >= k else 0.0
    spread = [(math.comb(BITS, h) * worst**h * (1 - worst) ** (BITS - h), agree(h, BITS, prefix), agree(h, BITS - prefix, depth)) for h in range(BITS // 2)]
    best = None
    for tries in range(1, 65 if depth else 2):
        found = [(w, p * (1 - (1 - q) ** tries)) for w, p, q in spread]
        groups = 1
        while groups < 4096 and sum(w * (1 - f) ** groups for w, f in found) > 1 - recall:
            groups += 1
        cost = groups * (ROW_COST + tries)
        if best is None or cost < best[0]:
            best = cost, groups, tries
    return Shape(prefix, best[1], depth, best[2], leaf, _bound(differ), _bound(worst), similarity)


def _prefix(bits: np.ndarray):
    """The prefix of a text's signature as a column expression."""
    out = F.lit(0).cast("long")
    for t, b in enumerate(bits.tolist()):
        bit = F.shiftrightunsigned(F.col(f"s{b >> 6}"), b & 63).bitwiseAND(F.lit(1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(bit, t))
    return out


def _carried(texts: DataFrame) -> list[str]:
    return ["parity"] if "parity" in texts.columns else []


def forest(texts: DataFrame, form: Shape) -> DataFrame:
    """Every text in every group: ``group`` (its number and prefix) and what pairing needs."""
    groups = [F.lit(g << form.prefix).cast("long") + _prefix(bits) for g, (bits, _) in enumerate(form.orders())]
    return texts.select(F.explode(F.array(*groups)).alias("group"), "node", "s0", "s1", F.col("n_shingles").cast("int").alias("n_shingles"), "label", *_carried(texts))


def _key(s: tuple[np.ndarray, np.ndarray], bits: np.ndarray) -> np.ndarray:
    """The chosen bits of each signature as a number, the first bit on top."""
    out = np.zeros(len(s[0]), dtype=np.uint32)
    for b in bits.tolist():
        out = (out << np.uint32(1)) | ((s[b >> 6] >> np.uint64(b & 63)) & np.uint64(1)).astype(np.uint32)
    return out


def _runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))


def subtrees(key: np.ndarray, depth: int, leaf: int, climb: int) -> list[tuple[int, int]]:
    """Ranges of sorted keys to compare in: short prefixes where sparse, else ``depth`` bits."""
    out, todo = [], [(0, len(key))]
    for d in range(depth - climb, depth + 1):
        rest = []
        for a, b in todo:
            edges = _runs(key[a:b] >> np.uint32(KEY_BITS - d)) + a if d else np.array([a, b])
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if y - x > 1:
                    (out if d == depth or y - x <= leaf else rest).append((x, y))
        todo = rest
    return out


class Group:
    """The texts of one group (or a piece of it), held by one task."""

    def __init__(self, form: Shape, node, s0, s1, size, label=None, parity=None):
        self.parity = parity and (parity[0], np.concatenate([[0], np.cumsum(parity[1])]))
        self.form, self.node, self.size, self.label = form, node, size.astype(np.int64), label
        self.s = s0.view(np.uint64), s1.view(np.uint64)
        self.limit = np.where(size <= SMALL_SHINGLES, form.small_bound, form.bound).astype(np.uint8)

    def match(self, i: np.ndarray, j: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions (x, y) in i and j of the pairs that can be near-duplicates of different labels, and all distances.

        ``before``: i and j end with the same rows; only pairs with j earlier count.
        """
        ham = np.bitwise_count(self.s[0][i][:, None] ^ self.s[0][j][None, :]) + np.bitwise_count(self.s[1][i][:, None] ^ self.s[1][j][None, :])
        x, y = np.nonzero(ham <= self.form.small_bound)
        if before:
            ok = y < x + (len(j) - len(i))
            x, y = x[ok], y[ok]
        ok = self.bounded(i[x], j[y], ham[x, y])
        if self.label is not None:
            ok &= self.label[i[x]] != self.label[j[y]]
        return x[ok], y[ok], ham

    def bounded(self, p: np.ndarray, q: np.ndarray, ham: np.ndarray) -> np.ndarray:
        """Which pairs of rows with these distances pass the bounds on distance and sizes."""
        return (ham <= np.maximum(self.limit[p], self.limit[q])) & (np.minimum(self.size[p], self.size[q]) >= self.form.similarity * np.maximum(self.size[p], self.size[q]))

    def keep(self, row: np.ndarray, distance: np.ndarray, other: np.ndarray, best: np.ndarray, who: np.ndarray):
        nearer = distance < best[row]
        best[row[nearer]], who[row[nearer]] = distance[nearer], other[nearer]

    def nearest(self, order: np.ndarray, ranges: list[tuple[int, int]], later: np.ndarray, best: np.ndarray, who: np.ndarray, dense: int):
        """Round one in the subtrees of a trie: pairs of each row with those before it if they are few.

        Else the nearest is kept in ``who``, and its distance in ``best``, if
        no subtree had a nearer one; the rows of the pairs left out are noted
        in ``later``. Subtrees of more than ``dense`` rows go to ``window``,
        the others some at a time to ``by_size``.
        """
        held, n = [], 0
        for p, q in ranges:
            if q - p > dense:
                yield from self.window(order[p:q], later, best, who)
                continue
            held.append(order[p:q])
            n += q - p
            if n >= BATCH_ROWS:
                yield from self.by_size(held, later, best, who)
                held, n = [], 0
        if held:
            yield from self.by_size(held, later, best, who)

    def by_size(self, subtrees: list[np.ndarray], later: np.ndarray, best: np.ndarray, who: np.ndarray):
        """``nearest`` where the rows before a row are the smaller ones; only those whose size can reach the similarity are looked at."""
        rows = np.concatenate(subtrees)
        place = (np.repeat(np.arange(len(subtrees)), [len(x) for x in subtrees]) << 32) + self.size[rows]
        by = np.argsort(place, kind="stable")
        rows, place = rows[by], place[by]
        s0, s1, size = self.s[0][rows], self.s[1][rows], self.size[rows]
        low = np.searchsorted(place, place - size + np.ceil(self.form.similarity * size - 1e-6).astype(np.int64))
        count = np.arange(len(rows)) - low
        ends = np.cumsum(count)
        a = 0
        while a < len(rows):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BATCH_LOOKS, side="right")))
            c, total = count[a:b], int(count[a:b].sum())
            if total:
                y = np.arange(total) + np.repeat(low[a:b] - (np.cumsum(c) - c), c)
                ham = np.bitwise_count(np.repeat(s0[a:b], c) ^ s0[y]) + np.bitwise_count(np.repeat(s1[a:b], c) ^ s1[y])
                at = np.flatnonzero(ham <= self.form.small_bound)
                x, y, ham = a + np.searchsorted(ends[a:b] - (ends[a] - count[a]), at, side="right"), y[at], ham[at]
                ok = self.bounded(rows[x], rows[y], ham)
                x, y, ham = x[ok], y[ok], ham[ok]
                left = np.bincount(x - a, minlength=b - a)[x - a] > FEW
                if left.any():
                    u, v = x[left], y[left]
                    later[rows[u]] = later[rows[v]] = True
                    first = _runs(u)[:-1]
                    near = np.minimum.reduceat((ham[left].astype(np.int64) << 32) + v, first)
                    self.keep(rows[u[first]], near >> 32, rows[near & 0xFFFFFFFF], best, who)
                    x, y = x[~left], y[~left]
                yield rows[x], rows[y]
            a = b

    def window(self, rows: np.ndarray, later: np.ndarray, best: np.ndarray, who: np.ndarray):
        """``nearest`` in a dense subtree: only WINDOW rows before each in key order are looked at, and all are noted."""
        later[rows] = True
        for a in range(0, len(rows), 512):
            i = rows[a : a + 512]
            j = rows[max(0, a - WINDOW) : a + len(i)]
            x, y, ham = self.match(i, j, True)
            many = np.bincount(x, minlength=len(i)) > FEW
            if many.any():
                left = many[x]
                least = np.full(ham.shape, 255, np.uint8)
                least[x[left], y[left]] = ham[x[left], y[left]]
                at = np.flatnonzero(many)
                near = least[at].argmin(axis=1)
                self.keep(i[at], least[at, near], j[near], best, who)
                x, y = x[~left], y[~left]
            yield i[x], j[y]

    def across(self, rows: np.ndarray):
        """Round two in a subtree: all pairs of different labels. Rows of the commonest label needn't meet each other."""
        names, count = np.unique(self.label[rows], return_counts=True)
        if len(names) < 2:
            return
        rest = rows[self.label[rows] != names[count.argmax()]]
        step = max(1, (1 << 21) // len(rows))
        for a in range(0, len(rest), step):
            i = rest[a : a + step]
            x, y, _ = self.match(i, rows, False)
            x, y = i[x], rows[y]
            if self.parity and len(x):
                ok = can_link(*self.parity, self.size, x, y, self.form.similarity)
                x, y = x[ok], y[ok]
            yield x, y

    def pairs(self, tries: list[np.ndarray], dense: int, first: bool):
        """Batches (a, b) of distinct candidates, a < b, each at most about BATCH_PAIRS; round one ends with (node, None), the texts to be seen again."""
        later = np.zeros(len(self.node), dtype=bool)
        best, who = np.full(len(self.node), 255, dtype=np.uint8), np.zeros(len(self.node), dtype=np.int64)
        held, n = [], 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*held))
            a, b = self.node[a], self.node[b]
            pair = np.unique(np.rec.fromarrays([np.minimum(a, b), np.maximum(a, b)], names="a,b"))
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pair.a)), pa.array(np.ascontiguousarray(pair.b))], names=["a", "b"])

        for bits in tries:
            key = _key(self.s, bits)
            order = np.argsort(key, kind="stable")
            ranges = subtrees(key[order], self.form.depth, self.form.leaf, min(CLIMB, self.form.depth))
            for i, j in self.nearest(order, ranges, later, best, who, dense) if first else (x for p, q in ranges for x in self.across(order[p:q])):
                if len(i):
                    held.append((i, j))
                    n += len(i)
                    if n > BATCH_PAIRS:
                        yield flush()
                        held, n = [], 0
        if (best < 255).any():
            held.append((np.flatnonzero(best < 255), who[best < 255]))
        if held:
            yield flush()
        if later.any():
            yield pa.RecordBatch.from_arrays([pa.array(self.node[later]), pa.nulls(int(later.sum()), pa.int64())], names=["a", "b"])


def _pieces(rows: DataFrame, hot: int, piece: int, first: bool) -> DataFrame:
    """``rows`` with ``piece``, cutting groups of more than ``hot`` texts.

    Round one only saves pairs and takes a piece after the other of the rows
    in order, so one number does. In round two a text is in one piece by its
    hash; texts outside the group's commonest label are in all pieces.
    """
    if first:
        return rows.withColumn("piece", F.lit(0))
    counts = cut(rows.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot))
    n = counts.count()
    if not n:
        discard(counts)
        return rows.withColumn("piece", F.lit(0))
    few = F.broadcast if n <= BROADCAST_GROUPS else (lambda x: x)
    of = rows.join(few(counts), "group").groupBy("group", "_n", "label").agg(F.count(F.lit(1)).alias("_c"))
    main = cut(of.groupBy("group").agg(F.max_by("label", F.struct("_c", "label")).alias("_main"), F.ceil(F.max("_n") / piece).cast("int").alias("_pieces")))
    discard(counts)
    rows = rows.join(few(main), "group", "left")
    own = F.array(F.coalesce(F.pmod(F.xxhash64("node"), F.col("_pieces")).cast("int"), F.lit(0)))
    every = F.sequence(F.lit(0), F.col("_pieces") - 1)
    return rows.withColumn("piece", F.explode(F.when(F.col("label") != F.col("_main"), every).otherwise(own))).drop("_main", "_pieces")


def candidates(texts: DataFrame, form: Shape, *, dense: int, hot: int, piece: int, first: bool) -> DataFrame:
    """(a, b), a < b, that share a subtree and pass the bounds; in round one also (a, null), the texts of pairs left for round two.

    Pairs may repeat. ``texts`` has node, s0, s1, n_shingles and label; in
    round two their ``parity`` too, else the pairs aren't held against it.
    """
    rows = _pieces(forest(texts, form), hot, piece, first)
    names = ["group", "piece", "node", "s0", "s1", "n_shingles", *([] if first else ["label", *_carried(texts)])]
    # signatures in order, so that a piece of an endless group holds like texts
    # a number of tasks of our own: the work is in the comparing, not in the bytes by which tasks would be merged
    tasks = min(form.groups << form.prefix, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.select(*names).repartition(tasks, "group", "piece").sortWithinPartitions("group", "piece", "s0", "s1", "node")
    tries = [t for _, t in form.orders()]

    def run(batches):
        def search(at, parts):
            c = [np.concatenate(x) for x in zip(*parts)]
            yield from Group(form, *c[:5], parity=(c[5], c[6]) if len(c) > 5 else None).pairs(tries[at[0] >> form.prefix], dense, first)

        at, parts, n = None, [], 0
        for batch in batches:
            c = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(names)) if names[k] != "parity"]
            words, sizes = _parity_words(batch.column(names.index("parity"))) if "parity" in names else (None, None)
            at_word = None if sizes is None else np.concatenate([[0], np.cumsum(sizes)])
            edges = np.flatnonzero(np.concatenate([[True], (c[0][1:] != c[0][:-1]) | (c[1][1:] != c[1][:-1]), [True]])) if batch.num_rows else [0]
            for x, y in zip(edges[:-1], edges[1:]):
                here = int(c[0][x]), int(c[1][x])
                if here != at and parts:
                    yield from search(at, parts)
                    parts, n = [], 0
                at = here
                parts.append([v[x:y] for v in c[2:]] + ([] if words is None else [words[at_word[x] : at_word[y]], sizes[x:y]]))
                n += y - x
                if first and n > hot:  # the next piece begins with the last rows of this one
                    yield from search(at, parts)
                    c2 = [np.concatenate(v) for v in zip(*parts)]
                    # what lies in different pieces is left for round two
                    yield pa.RecordBatch.from_arrays([pa.array(c2[0]), pa.nulls(n, pa.int64())], names=["a", "b"])
                    parts = [[v[-WINDOW:] for v in c2]]
                    n = len(parts[0][0])
        if parts:
            yield from search(at, parts)

    return rows.mapInArrow(run, "a long, b long")


def _of_texts(nodes: DataFrame, docs: DataFrame, texts: DataFrame, text: str, kind: str, make) -> DataFrame:
    """(node, value): what ``make`` of the shingle sets gives, once for each of the nodes. ``nodes`` may repeat."""
    wanted = cut(nodes.distinct().join(texts.select("node", "text_key"), "node").select("text_key").distinct())
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    rows = docs.select(F.col(text).alias("text"), F.xxhash64(text).alias("text_key")).join(few, "text_key", "left_semi").select("text_key", "text")

    def run(batches):
        done: set[int] = set()  # a task sends the set of each text once
        for b in batches:
            fresh = []
            for k, key in enumerate(b.column(0).to_numpy().tolist()):
                if key not in done:
                    done.add(key)
                    fresh.append(k)
            for i, j, words in textvec.word_chunks(b.column(1).take(pa.array(fresh, pa.int64()))):
                whole = _sequence_hash(words.hash, words.offs, 1)
                yield pa.RecordBatch.from_arrays([_signed(whole), make(*shingle_sets(words, whole))], names=["node", "value"])

    out = cut(rows.mapInArrow(run, f"node long, value {kind}").groupBy("node").agg(F.first("value").alias("value")))
    discard(wanted)
    return out


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _both(pairs: DataFrame, values: DataFrame) -> DataFrame:
    return pairs.join(values.withColumnsRenamed({"node": "a", "value": "x"}), "a").join(values.withColumnsRenamed({"node": "b", "value": "y"}), "b")


def linkable(pairs: DataFrame, sized: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose parities (``value`` of ``sized``, which has n_shingles too) allow the similarity."""
    met = _both(pairs, sized.select("node", F.struct(F.col("n_shingles").alias("n"), F.col("value").alias("v")).alias("value")))

    def run(batches):
        for b in batches:
            words, sizes = zip(*(_parity_words(b.column(k)) for k in (4, 5)))
            size = np.concatenate([b.column(k).to_numpy() for k in (2, 3)])
            offs = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            p = np.arange(b.num_rows)
            ok = can_link(np.concatenate(words), offs, size, p, p + b.num_rows, similarity)
            yield b.select([0, 1]).filter(pa.array(ok))

    return met.select("a", "b", "x.n", F.col("y.n").alias("m"), "x.v", F.col("y.v").alias("w")).mapInArrow(run, "a long, b long")


def folded(parity: DataFrame) -> DataFrame:
    """(node, parity) with parities of at most PARITY_BITS."""
    most = PARITY_BITS >> 6

    def run(batches):
        for b in batches:
            words, sizes = _parity_words(b.column(1))
            offs, width = np.concatenate([[0], np.cumsum(sizes)]), np.minimum(sizes, most)
            to = np.concatenate([[0], np.cumsum(width)])
            out = np.zeros(int(to[-1]), dtype=np.uint64)
            for w in np.unique(width).tolist():
                rows = np.flatnonzero(width == w)
                out[to[rows][:, None] + np.arange(w)] = fold(words, offs, rows, w)
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(out, to)], names=["node", "parity"])

    return parity.select("node", "value").mapInArrow(run, "node long, parity binary")


def verify(pairs: DataFrame, sized: DataFrame, docs: DataFrame, texts: DataFrame, text: str, similarity: float) -> DataFrame:
    """The pairs whose whole shingle sets reach the similarity. ``pairs`` are distinct; ``sized`` has the parities of their texts."""
    pairs = cut(linkable(pairs, sized, similarity))
    make = lambda sh, offs: pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(sh.astype(np.int64)))
    sets = _of_texts(_ends(pairs), docs, texts, text, "array<long>", make)
    shared = F.size(F.array_intersect("x", "y"))
    out = cut(_both(pairs, sets).where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b"))
    discard(pairs, sets)
    return out


def classes(
    docs: DataFrame, *, text: str = "text", similarity: float = 0.8, recall: float = 0.99, leaf: int = 256, dense: int = 8192, capacity: int = 1 << 20, hot: int = 1 << 21, piece: int = 1 << 20
) -> DataFrame:
    """doc_id, text_key, class_id (smallest id of the class), class_size and keep, one row a document."""
    docs = docs.select("doc_id", F.col(text).alias("text"))
    drawn = cut(sketch(docs, "text"))
    texts = cut(drawn.where("n_shingles > 0").groupBy("node").agg(*[F.min(c).alias(c) for c in ("text_key", "n_shingles", "s0", "s1")]))
    form = shape(texts.count(), similarity, recall, leaf, capacity)
    sizes = dict(dense=dense, hot=hot, piece=piece)
    found = cut(candidates(texts.withColumn("label", F.col("node")), form, first=True, **sizes))
    first = cut(found.where("b is not null").distinct())
    marked = found.where("b is null").select(F.col("a").alias("node")).distinct()
    parity = _of_texts(_ends(first).union(marked), docs, texts, "text", "binary", lambda sh, offs: _binary(*parities(sh, offs)))
    sized = parity.join(texts.select("node", "n_shingles"), "node")
    links = verify(first, sized, docs, texts, "text", similarity)
    labels = components(links)
    again = texts.join(marked, "node").join(folded(parity), "node")
    known = cut(again.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")))
    second = cut(candidates(known, form, first=False, **sizes).distinct().join(first, ["a", "b"], "left_anti"))
    discard(found, first, known)
    if second.limit(1).count():
        more = verify(second, sized, docs, texts, "text", similarity)
        if more.limit(1).count():
            discard(labels)
            labels = components(links.unionAll(more))
        discard(more)
    discard(second, links, texts, parity)
    # rows of each text first, then of each class: both combine before the shuffle
    placed = drawn.join(labels, "node", "left").withColumn("_class", F.coalesce("label", "node"))
    head = F.min(F.when(F.isnotnull("doc_id"), F.struct("doc_id", "text_key")))
    kept = cut(placed.groupBy("_class").agg(F.count(F.lit(1)).alias("class_size"), head.alias("_head"), F.min("text_key").alias("_least")).where("class_size > 1"))
    big = kept.select("_class", "class_size", F.col("_head.doc_id").alias("class_id"), F.coalesce("_head.text_key", "_least").alias("_text"))
    big = F.broadcast(big) if kept.count() <= BROADCAST_TEXTS else big
    out = placed.select("doc_id", "text_key", "_class").join(big, "_class", "left")
    return out.select(
        "doc_id", "text_key",
        F.when(F.col("class_size").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"),
        (F.col("class_size").isNull() | (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_key") == F.col("_text")))).alias("keep"),
    )


def deduplicate(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id."""
    found = cut(classes(docs, text=text, **options))
    gone = cut(found.where(~F.col("keep")).select("doc_id", "text_key").distinct())
    few = F.broadcast(gone) if gone.count() <= BROADCAST_TEXTS else gone
    rows = docs.withColumn("_text_key", F.xxhash64(text))
    kept = rows.join(few, rows["doc_id"].eqNullSafe(few["doc_id"]) & (rows["_text_key"] == few["text_key"]), "left_anti")
    stay = found.where("keep")
    # rows repeated with their id: one of them stays
    if stay.count() > stay.select("doc_id", "text_key").distinct().count():
        kept = kept.dropDuplicates(["doc_id", "_text_key"])
    return kept.select(*docs.columns)
