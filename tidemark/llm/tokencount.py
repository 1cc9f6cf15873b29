"""Token counts by byte-pair merging, without token ids.

Reads the vocabulary file of a word-level byte-pair tokenizer (normaliser NFC,
white-space folding, lower case; pieces by pattern; an end-of-word suffix) and
counts what its library would return: for each piece, a heap of adjacent pairs
by merge rank over a linked list of symbols pops the lowest rank (then the
leftmost) until no pair merges; the count is the number of initial symbols
less the merges. Pieces repeat, so counts are remembered in bounded per-worker
tables.

Documents of ASCII and Latin-1 letters only (no apostrophe, no special string)
are cut into pieces by byte classes, a chunk of documents at once, and the
pieces' counts come from a direct-mapped table by 64-bit hash; any other
document goes through the vocabulary's own pattern. Both ways give the same
counts.

Special strings inside a text are matched before normalisation and count as
one token each, as the library does by default. Null and empty text: 0 bytes,
0 tokens.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
REMEMBER = 300_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte that byte-level vocabularies use."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


class Counter(dict):
    """Tokens of a piece; remembers what it has counted."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[vocab[a], vocab[b]] = (r, vocab[a + b])
        symbols = byte_symbols()
        self.inner = [vocab.get(x) for x in symbols]
        self.last = [vocab.get(x + self.suffix) for x in symbols]
        specials = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.marks = specials
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall

    def __missing__(self, piece: str) -> int:
        if len(self) >= REMEMBER:
            self.clear()
        n = self[piece] = self.merge(piece)
        return n

    def merge(self, piece: str) -> int:
        return self.merge_bytes(piece.encode())

    def merge_bytes(self, piece: bytes) -> int:
        ids = [*map(self.inner.__getitem__, piece[:-1]), self.last[piece[-1]]]
        if None in ids:  # a symbol that the vocabulary lacks is dropped
            ids = [i for i in ids if i is not None]
        n = left = len(ids)
        rank = self.rank.get
        heap = []
        for i in range(n - 1):
            r = rank((ids[i], ids[i + 1]))
            if r:
                heap.append((r[0], i, ids[i], ids[i + 1], r[1]))
        if not heap:
            return left
        heapq.heapify(heap)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            _, i, a, b, made = pop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            left -= 1
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                r = rank((made, ids[j]))
                if r:
                    push(heap, (r[0], i, made, ids[j], r[1]))
            h = before[i]
            if h >= 0:
                r = rank((ids[h], made))
                if r:
                    push(heap, (r[0], h, ids[h], made, r[1]))
        return left

    def plain(self, text: str) -> int:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:  # lower case is by character: no final sigma
            text = text.replace("Σ", "σ")
        return sum(map(self.__getitem__, self.pieces(text.lower())))

    def count(self, text: str) -> int:
        if self.special is None or not any(m in text for m in self.marks):
            return self.plain(text)
        return len(self.special.findall(text)) + sum(map(self.plain, self.special.split(text)))


#: Byte classes: 0 white space, 1 letter (of ASCII, or a part of U+00C0-U+00FF), 2 digit, 3 other, 4 for the slow way.
_CLASS = np.full(256, 3, dtype=np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = 0
_CLASS[65:91] = _CLASS[97:123] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = 1
_CLASS[48:58] = 2
_CLASS[0xC0:] = 4
_CLASS[0xC3] = 1
_CLASS[39] = 4
SLOTS = 1 << 21


class Fast:
    """Counts of chunks of documents, with a direct-mapped table of pieces."""

    def __init__(self, slow: Counter):
        self.slow = slow
        self.key = np.zeros(SLOTS, dtype=np.uint64)
        self.n = np.zeros(SLOTS, dtype=np.uint32)

    def chunk(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each document, and whether it needs the slow way (then the tokens mean nothing)."""
        size = len(bounds) - 1
        if not len(data):
            return np.zeros(size, np.int64), np.zeros(size, bool)
        c = _CLASS[data]
        odd = c == 4
        lead = np.flatnonzero(data == 0xC3)
        after = data[np.minimum(lead + 1, len(data) - 1)]
        odd[lead[(after == 0x97) | (after == 0xB7)]] = True
        for mark in self.slow.marks:  # a special string needs its first bytes in a row
            b = np.frombuffer(mark.encode()[:2], dtype=np.uint8)
            if len(b) == 2:
                odd[:-1] |= (data[:-1] == b[0]) & (data[1:] == b[1])
            else:
                odd |= data == b[0]
        total = np.concatenate([[0], np.cumsum(odd)])
        slow = np.diff(total[bounds]) > 0
        low = textvec._LOWER[data]
        upper = lead[(after >= 0x80) & (after <= 0x9E)] + 1
        low[upper] += 0x20
        before = np.empty_like(c)
        behind = np.empty_like(c)
        before[0], before[1:] = 0, c[:-1]
        behind[-1], behind[:-1] = 0, c[1:]
        before[bounds[:-1][bounds[:-1] < len(c)]] = 0
        behind[bounds[1:][bounds[1:] > 0] - 1] = 0
        some, digit = c != 0, c == 2
        start = np.flatnonzero(some & ((c != before) | digit))
        end = np.flatnonzero(some & ((c != behind) | digit)) + 1
        first = np.searchsorted(start, bounds)
        if slow.any():
            fine = np.repeat(~slow, np.diff(first))
            start, end = start[fine], end[fine]
            first = np.searchsorted(start, bounds)
        h = textvec.span_hashes(low, start, end) | np.uint64(1)
        slot = (h >> np.uint64(20)) & np.uint64(SLOTS - 1)
        n = self.n[slot]
        miss = np.flatnonzero(self.key[slot] != h)
        if len(miss):
            fresh, at, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            raw = low.tobytes()
            at = miss[at]
            merge = self.slow.merge_bytes
            made = np.fromiter((merge(raw[a:b]) for a, b in zip(start[at].tolist(), end[at].tolist())), dtype=np.uint32, count=len(at))
            n[miss] = made[inverse]
            self.key[slot[at]] = fresh
            self.n[slot[at]] = made
        return np.diff(np.concatenate([[0], np.cumsum(n, dtype=np.int64)])[first]), slow


def public(name: str) -> Callable[[], str]:
    """The place of a public tokenizer's file, asked for where it is read: on each executor."""

    def place() -> str:
        import public_tokenizers

        return public_tokenizers.path(name)

    return place


_counters: dict[str, Fast] = {}


def counter(path: str) -> Fast:
    if path not in _counters:
        _counters[path] = Fast(Counter(path))
    return _counters[path]


def token_counts(docs: DataFrame, vocabulary: str | Callable[[], str], *, text: str = "text", limit: int = 2048) -> DataFrame:
    """The rows of ``docs`` with n_bytes, n_tokens and over_limit (n_tokens > ``limit``).

    Input columns with these names are replaced. ``vocabulary`` is a path that
    every executor can read, or a function that finds it there.
    """

    def compute(batch: pa.RecordBatch) -> list:
        fast = counter(vocabulary if isinstance(vocabulary, str) else vocabulary())
        col = textvec.text_column(batch, text)
        _, offs = textvec.buffers(col)
        n = np.zeros(len(col), dtype=np.int64)
        for i, j, data, bounds in textvec.chunks(col):
            n[i:j], slow = fast.chunk(data, bounds)
            for d in np.flatnonzero(slow).tolist():
                n[i + d] = fast.slow.count(data[bounds[d] : bounds[d + 1]].tobytes().decode())
        return [pa.array(np.diff(offs)), pa.array(n), pa.array(n > limit)]

    return util.with_columns(docs, FIELDS, compute)
