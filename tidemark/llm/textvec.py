"""Vectorised tokenising and hashing of whole Arrow string columns.

The text operators work on the bytes of an Arrow batch at once instead of
looping over rows: word boundaries, word hashes and k-gram hashes of many
documents come from a handful of numpy passes over one buffer. A batch is cut
into chunks of about ``CHUNK_BYTES`` (never inside a document), which bounds
the temporaries whatever the batch holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
CHUNK_DOCS = 1 << 16
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_MUL))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True


def _powers(n: int, mul: int, cache: dict[int, np.ndarray] = {}) -> np.ndarray:
    have = cache.get(mul)
    if have is None or len(have) < n:
        out = np.full(max(n, CHUNK_BYTES + 1), mul, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 4 * CHUNK_BYTES:
            cache[mul] = have
    return have[:n]


class Words:
    """Words of a run of documents.

    ``start``/``end`` are byte positions in ``data``; ``offs[d]:offs[d + 1]``
    are the words of document ``d``; ``hash`` is a 64-bit hash of each word's
    lower-cased bytes.
    """

    __slots__ = ("data", "start", "end", "offs", "hash")

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hashed: bool = True):
        n = len(data)
        starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for p in range(0, n, CHUNK_BYTES):
            q = min(n, p + CHUNK_BYTES)
            isw = WORD[_LOWER[data[max(p - 1, 0) : q + 1]]]
            if p == 0:
                isw = np.concatenate([[False], isw])
            if q == n:
                isw = np.concatenate([isw, [False]])
            # word bytes before and after each byte, none across documents
            before, after, isw = isw[:-2].copy(), isw[2:].copy(), isw[1:-1]
            first = bounds[:-1]
            before[first[(first >= p) & (first < q)] - p] = False
            last = bounds[1:] - 1
            after[last[(last >= p) & (last < q)] - p] = False
            starts.append(np.flatnonzero(isw & ~before) + p)
            ends.append(np.flatnonzero(isw & ~after) + (p + 1))
        self.data = _LOWER[data]
        self.start = np.concatenate(starts)
        self.end = np.concatenate(ends)
        self.offs = np.searchsorted(self.start, bounds)
        self.hash = span_hashes(self.data, self.start, self.end) if hashed else None


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans ``start:end`` of ``data``, which are in order and apart.

    The data are gone over in slices, so that the temporaries are bounded.
    """
    out = np.zeros(len(start), dtype=np.uint64)
    for p in range(0, len(data), CHUNK_BYTES):
        x = data[p : p + CHUNK_BYTES]
        a, b = int(np.searchsorted(end, p, side="right")), int(np.searchsorted(start, p + len(x), side="left"))
        if a >= b:
            continue
        acc = np.zeros(len(x) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[x] * _powers(len(x), _MUL), out=acc[1:])
        s, e = np.maximum(start[a:b] - p, 0), np.minimum(end[a:b] - p, len(x))
        part = (acc[e] - acc[s]) * _powers(len(x) + 1, _INV)[s]
        if start[a] < p:  # a word from the slice before goes on
            part[:1] *= np.uint64(pow(_MUL, int(p - start[a]), 1 << 64))
        out[a:b] += part
    return mix(out)


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and the ``len + 1`` offsets of a string column; null counts as empty."""
    col = col.cast(pa.large_string()).fill_null("")
    _, offs, data = col.buffers()
    offs = np.frombuffer(offs, dtype=np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offs


def chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yield ``(first, last, bytes, bounds)`` runs of whole documents of about ``max_bytes``."""
    data, offs = buffers(col)
    i, n = 0, len(offs) - 1
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1), i + CHUNK_DOCS)
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def word_chunks(col: pa.Array, max_bytes: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Words]]:
    for i, j, data, bounds in chunks(col, max_bytes):
        yield i, j, Words(data, bounds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every run of ``k`` consecutive words; the last ``k - 1`` starts are left out."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out *= np.uint64(_MUL)
        out += hashes[j : j + n]
    return mix(out)


def gram_valid(offs: np.ndarray, k: int, n: int) -> np.ndarray:
    """True where a k-gram start (of ``n`` grams) stays inside its document."""
    ok = np.ones(max(n, 0), dtype=bool)
    ends = offs[1:]
    for j in range(1, k):
        at = ends - j
        at = at[(at >= 0) & (at < n)]
        ok[at] = False
    return ok


def text_column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
