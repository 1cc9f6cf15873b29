"""Language identification by script ranges and a Viterbi path over words.

Learning (on the driver, from at most ``max_docs`` labelled rows of each
language that aren't held out, in the order of a hash of the id and text, and
of no more than ``max_bytes`` of text each but for the last): hashed byte
2-, 3- and 4-grams and whole words of each language give tables of log-odds,
and the letters' scripts give each language's share by script.

Prediction: a word's script (by code-point ranges, from its first letter)
narrows the languages to those written in it; the word's score for each
candidate is the sum of its table rows. A Viterbi path over the words with a
constant switching penalty labels spans of one language; a document's language
is that of most letters along the path and its score their share. The path is
exact: blocks of words compute their (max, +) transfer matrices in parallel,
the blocks of a document are then chained, and a second sweep traces back. A
document longer than PIECE bytes goes through in pieces: the first sweep keeps
the path values at their ends, the second reads the pieces again from the last,
so that memory doesn't grow with the text but for its own bytes.

Defined results: null text, or text without a letter, is ``und`` with score 0;
with nothing learned every text is ``und``; a language with few rows is
learned from those; ties go to the language that sorts first; letters that go
on for more than PIECE bytes are words of that length.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("words", T.IntegerType())]))),
]
GRAM_BITS, WORD_BITS = 16, 18
BLOCK = 32
PIECE = 1 << 18
#: Numbers in the transfer matrices of the documents that are worked on together.
MATRICES = 1 << 22
#: Script by lead byte of UTF-8 (two-byte scripts) or by code point below.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "hangul", "kana", "han", "other")
_RANGES = (
    (0x41, 0x24F, 0), (0x250, 0x2AF, 0), (0x370, 0x3FF, 1), (0x400, 0x52F, 2), (0x530, 0x58F, 3), (0x590, 0x5FF, 4), (0x600, 0x77F, 5),
    (0x900, 0xDFF, 6), (0xE00, 0xE7F, 7), (0x10A0, 0x10FF, 8), (0x1100, 0x11FF, 9), (0x1E00, 0x1EFF, 0), (0x1F00, 0x1FFF, 1),
    (0x3040, 0x30FF, 10), (0x3130, 0x318F, 9), (0x3400, 0x9FFF, 11), (0xAC00, 0xD7AF, 9), (0x20000, 0x3FFFF, 11),
)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[128:] = True


def script_of(point: np.ndarray) -> np.ndarray:
    out = np.full(point.shape, len(SCRIPTS) - 1, dtype=np.int64)
    for a, b, s in _RANGES:
        out[(point >= a) & (point <= b)] = s
    return out


def first_points(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Code points of the characters that begin at ``at``."""
    last = len(data) - 1
    b = [data[np.minimum(at + k, last)].astype(np.int64) for k in range(4)]
    two = (b[0] & 0x1F) << 6 | b[1] & 0x3F
    three = (b[0] & 0x0F) << 12 | (b[1] & 0x3F) << 6 | b[2] & 0x3F
    four = (b[0] & 0x07) << 18 | (b[1] & 0x3F) << 12 | (b[2] & 0x3F) << 6 | b[3] & 0x3F
    return np.where(b[0] < 0x80, b[0], np.where(b[0] < 0xE0, two, np.where(b[0] < 0xF0, three, four)))


class Text:
    """Letter runs of a chunk of documents and the rows of the tables they touch."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        low = textvec._LOWER[data]
        lead = np.flatnonzero(low == 0xC3)
        if len(lead) and lead[-1] == len(low) - 1:
            lead = lead[:-1]
        after = low[lead + 1]
        low[lead[(after >= 0x80) & (after <= 0x9E) & (after != 0x97)] + 1] += 0x20
        isw = _LETTER[low]
        n = len(low)
        before, behind = np.empty(n, bool), np.empty(n, bool)
        if n:
            before[0], before[1:] = False, isw[:-1]
            behind[-1], behind[:-1] = False, isw[1:]
            before[bounds[:-1][bounds[:-1] < n]] = False
            behind[bounds[1:][bounds[1:] > 0] - 1] = False
        self.start = np.flatnonzero(isw & ~before)
        self.end = np.flatnonzero(isw & ~behind) + 1
        self.offs = np.searchsorted(self.start, bounds)
        self.low = low
        self.word = (textvec.span_hashes(low, self.start, self.end) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        # bytes with word ends folded to 0: grams of a word see its bounds
        size = self.end - self.start
        total = int((size + 1).sum())
        self.length = size
        base = np.concatenate([[0], np.cumsum(size + 1)])
        z = np.zeros(total + 3, dtype=np.uint64)
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        z[np.repeat(base[:-1], size) + pos + 3] = low[np.repeat(self.start, size) + pos] if total else 0
        self.base = base
        g2 = z[2:-1] << np.uint64(8) | z[3:]
        g3 = z[1:-2] << np.uint64(16) | g2
        g4 = z[:-3] << np.uint64(24) | g3
        take = lambda g, k: ((g * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - GRAM_BITS)).astype(np.int64)
        # in the four-gram the byte before the bound belongs to the word before: only inside words
        inside = (z[2:-1] != 0) | (z[1:-2] == 0)
        self.grams = (take(g2, 2), take(g3, 3), np.where(inside, take(g4, 4), 0))
        self.script = script_of(first_points(low, self.start)) if len(self.start) else np.zeros(0, np.int64)


class Model:
    def __init__(self, langs: list[str], grams: list[np.ndarray], words: np.ndarray, scripts: np.ndarray, penalty: float):
        self.langs, self.grams, self.words, self.scripts, self.penalty = langs, grams, words, scripts, penalty

    def word_scores(self, t: Text) -> np.ndarray:
        total = sum(table[g] for table, g in zip(self.grams, t.grams))
        acc = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(total, axis=0, dtype=np.float64)])
        e = acc[t.base[1:]] - acc[t.base[:-1]] + self.words[t.word]
        e = np.clip(e, -8, 8)
        return e + self.scripts[t.script]


def viterbi(scores: np.ndarray, offs: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each row; rows ``offs[d]:offs[d + 1]`` are a path of their own."""
    k = max(1, scores.shape[1])
    room = np.cumsum(-(-np.diff(offs) // BLOCK)) // max(1, MATRICES // (k * k))
    cuts = np.concatenate([[0], np.flatnonzero(room[1:] != room[:-1]) + 1, [len(room)]]) if len(room) else [0]
    parts = [np.zeros(0, np.int64)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        own = offs[a : b + 1]
        parts.append(sweep(scores[own[0] : own[-1]], own - own[0], penalty)[0])
    return np.concatenate(parts)


def sweep(scores: np.ndarray, offs: np.ndarray, penalty: float, start: np.ndarray | None = None, last_label: np.ndarray | None = None, forward: bool = False):
    """Best labels of the rows, and the label before each path; of paths that go on from the values ``start``, to the labels ``last_label`` where known.

    ``forward``: only the path values at the ends.
    """
    n, k = scores.shape
    size = np.diff(offs)
    blocks = -(-size // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    nb = int(first[-1])
    v = np.zeros((len(size), k)) if start is None else start.copy()
    if not nb:
        return v if forward else (np.zeros(0, dtype=np.int64), v.argmax(axis=1) if last_label is None else last_label)
    where = np.arange(n) - np.repeat(offs[:-1], size) + np.repeat(first[:-1] * BLOCK, size)
    e = np.zeros((nb * BLOCK, k))
    e[where] = scores
    e = e.reshape(nb, BLOCK, k)
    # transfer matrices of the blocks, in parallel; rows that fill up the last block allow the switch that comes next anyway
    d = np.where(np.eye(k, dtype=bool), 0.0, -np.inf)[None].repeat(nb, axis=0)
    for t in range(BLOCK):
        d = np.maximum(d, d.max(axis=2, keepdims=True) - penalty) + e[:, t, None, :]
    # the entry values of each block, along each document
    order = np.argsort(-blocks, kind="stable")
    entry = np.zeros((nb, k))
    most = int(blocks.max())
    active = [int(np.searchsorted(-blocks[order], -s, side="left")) for s in range(most)]
    for s in range(most):
        docs = order[: active[s]]
        b = first[docs] + s
        entry[b] = v[docs]
        v[docs] = (v[docs][:, :, None] + d[b]).max(axis=1)
    if forward:
        return v
    del d
    # forward once more with back pointers, and what each end label leads back to
    back = np.empty((BLOCK, nb, k), dtype=np.min_scalar_type(-k))
    x = entry
    for t in range(BLOCK):
        top = x.argmax(axis=1)
        jump = np.take_along_axis(x, top[:, None], 1) - penalty
        stay = x >= jump
        back[t] = np.where(stay, np.arange(k)[None, :], top[:, None])
        x = np.maximum(x, jump) + e[:, t]
    lead = np.arange(k)[None, :].repeat(nb, axis=0)
    for t in range(BLOCK - 1, -1, -1):
        lead = np.take_along_axis(back[t], lead, 1).astype(np.int64)
    label = np.empty((BLOCK, nb), dtype=np.int64)
    last = np.zeros(nb, dtype=np.int64)
    cur = v.argmax(axis=1) if last_label is None else last_label.copy()
    for s in range(most - 1, -1, -1):
        docs = order[: active[s]]
        b = first[docs] + s
        last[b] = cur[docs]
        cur[docs] = lead[b, cur[docs]]
    for t in range(BLOCK - 1, -1, -1):
        label[t] = last
        last = back[t][np.arange(nb), last].astype(np.int64)
    return label.T.ravel()[where], cur


def predict(model: Model, t: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language number and score of each document (-1 without letters), and the label of each word."""
    docs = len(t.offs) - 1
    label = viterbi(model.word_scores(t), t.offs, model.penalty) if len(t.start) else np.zeros(0, np.int64)
    letters = np.zeros((docs, len(model.langs)))
    np.add.at(letters, (np.repeat(np.arange(docs), np.diff(t.offs)), label), t.length)
    total = letters.sum(axis=1)
    best = np.where(total > 0, letters.argmax(axis=1), -1)
    return best, np.where(total > 0, letters.max(axis=1) / np.maximum(total, 1), 0.0), label


def pieces(data: np.ndarray, piece: int) -> list[tuple[int, int]]:
    """Ranges of about ``piece`` bytes that end before a byte of no word, or, in a word without end, before a character."""
    out, a = [], 0
    while a < len(data):
        b = min(len(data), a + piece)
        if b < len(data):
            near = data[b : b + piece]
            ends = np.flatnonzero(~_LETTER[textvec._LOWER[near]])
            if not len(ends):
                ends = np.flatnonzero((near & 0xC0) != 0x80)
            b += int(ends[0]) if len(ends) else 0
        out.append((a, b))
        a = b
    return out


def predict_long(model: Model, data: np.ndarray, piece: int) -> tuple[int, float, list[tuple[int, int]]]:
    """Language number and score of one document, and its runs of (label, words), a piece at a time."""
    parts = pieces(data, piece)
    at = lambda a, b: Text(data[a:b], np.array([0, b - a]))
    values = [np.zeros((1, len(model.langs)))]
    for a, b in parts:
        t = at(a, b)
        values.append(sweep(model.word_scores(t), t.offs, model.penalty, values[-1], forward=True) if len(t.start) else values[-1])
    letters = np.zeros(len(model.langs))
    runs: list[tuple[int, int]] = []
    label = values[-1].argmax(axis=1)
    for (a, b), start in zip(reversed(parts), reversed(values[:-1])):
        t = at(a, b)
        if not len(t.start):
            continue
        own, label = sweep(model.word_scores(t), t.offs, model.penalty, start, label)
        letters += np.bincount(own, weights=t.length, minlength=len(letters))
        edge = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
        for who, n in reversed(list(zip(own[edge[:-1]].tolist(), np.diff(edge).tolist()))):
            if runs and runs[-1][0] == who:
                runs[-1] = who, runs[-1][1] + n
            else:
                runs.append((who, n))
    total = letters.sum()
    return (int(letters.argmax()), float(letters.max() / total), runs[::-1]) if total else (-1, 0.0, [])


def _has_letter(data: np.ndarray) -> bool:
    for a, b in pieces(data, PIECE):
        low = data[a:b] | 32
        if np.any((low >= 97) & (low <= 122)) or any(map(str.isalpha, data[a:b].tobytes().decode(errors="ignore"))):
            return True
    return False


def fit(texts: list[str], langs: list[str], penalty: float = 12.0) -> Model:
    names = sorted(set(langs))
    k = len(names)
    number = {x: i for i, x in enumerate(names)}
    grams = [np.zeros((1 << GRAM_BITS, k), dtype=np.float64) for _ in range(3)]
    words = np.zeros((1 << WORD_BITS, k), dtype=np.float64)
    scripts = np.zeros((len(SCRIPTS), k))
    for lang in names:
        i = number[lang]
        own = pa.array([t for t, x in zip(texts, langs) if x == lang], type=pa.string())
        for *_, data, bounds in textvec.chunks(own):
            t = Text(data, bounds)
            for table, g in zip(grams, t.grams):
                table[:, i] += np.bincount(g, minlength=len(table))
            words[:, i] += np.bincount(t.word, minlength=len(words))
            scripts[:, i] += np.bincount(t.script, weights=t.length, minlength=len(SCRIPTS))

    def odds(table: np.ndarray, weight: float, smooth: float) -> np.ndarray:
        seen = table.sum(axis=1, keepdims=True) > 0
        p = np.log((table + smooth) / (table.sum(axis=0, keepdims=True) + smooth * len(table)))
        return (weight * np.where(seen, p - p.mean(axis=1, keepdims=True), 0)).astype(np.float32)

    share = scripts / np.maximum(scripts.sum(axis=0, keepdims=True), 1)
    used = share >= 0.002
    allowed = np.where(used | ~used.any(axis=1, keepdims=True), 0.0, -60.0)
    return Model(names, [odds(g, 0.25, 0.5) for g in grams], odds(words, 0.5, 0.5), allowed, penalty)


def train(docs: DataFrame, *, max_docs: int = 1500, max_bytes: int = 16 << 20, penalty: float = 12.0) -> Model:
    """Fit on ``max_docs`` rows of each language at most, and on ``max_bytes`` of text and one row (doc_id, text, lang), none held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~util.held_out() & F.col("doc_id").isNotNull())
    known = known.select("lang", "text", F.xxhash64("doc_id").alias("_a"), F.xxhash64("text").alias("_b"))
    # the first rows of each language are found on hashes; only the chosen texts travel
    order = W.partitionBy("lang").orderBy("_a", "_b")
    first = known.select("lang", "_a", "_b", F.octet_length("text").alias("_n")).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= max_docs)
    used = F.coalesce(F.sum("_n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chosen = util.cut(util.cut(first).withColumn("_used", used).where(F.col("_used") < max_bytes).select("lang", "_a", "_b").distinct())
    rows = known.join(F.broadcast(chosen), ["lang", "_a", "_b"]).dropDuplicates(["lang", "_a", "_b"])
    got = sorted((r["_a"], r["_b"], r["lang"], r["text"]) for r in rows.toLocalIterator())
    util.discard(chosen)
    return fit([r[3] for r in got], [r[2] for r in got], penalty) if got else Model([], [], np.zeros(0), np.zeros(0), penalty)


def identify(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and the spans (language, words) along the path."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        m: Model = shared.value
        col = textvec.text_column(batch, text)
        langs: list[str] = []
        scores, spans = [], []
        step = max(1 << 16, (1 << 21) // max(4, len(m.langs)))
        for i, j, data, bounds in textvec.chunks(col, step):
            if not m.langs:
                langs += ["und"] * (j - i)
                scores.append(np.zeros(j - i))
                spans += [[] for _ in range(j - i)]
                continue
            if j - i == 1 and len(data) > PIECE:
                who, share, runs = predict_long(m, data, PIECE)
                who, share, runs = (who, share, runs) if who >= 0 and _has_letter(data) else (-1, 0.0, [])
                langs.append("und" if who < 0 else m.langs[who])
                scores.append(np.array([share]))
                spans.append([{"lang": m.langs[w], "words": n} for w, n in runs])
                continue
            t = Text(data, bounds)
            best, share, label = predict(m, t)
            plain = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((data | 32 >= 97) & (data | 32 <= 122), out=plain[1:])
            ascii_letters = np.diff(plain[bounds])
            for d in np.flatnonzero((ascii_letters == 0) & (best >= 0)).tolist():
                # high bytes only: are there letters among them?
                if not any(map(str.isalpha, data[bounds[d] : bounds[d + 1]].tobytes().decode())):
                    best[d], share[d] = -1, 0.0
            langs += ["und" if b < 0 else m.langs[b] for b in best.tolist()]
            scores.append(share)
            edge = np.ones(len(label) + 1, dtype=bool)
            edge[1:-1] = label[1:] != label[:-1]
            edge[t.offs[t.offs < len(label)]] = True
            edge[-1] = True
            cuts = np.flatnonzero(edge)
            run = np.diff(cuts)
            at = np.searchsorted(cuts, t.offs)
            who = label[cuts[:-1]] if len(label) else label
            for d in range(j - i):
                spans.append([] if best[d] < 0 else [{"lang": m.langs[w], "words": int(r)} for w, r in zip(who[at[d] : at[d + 1]].tolist(), run[at[d] : at[d + 1]].tolist())])
        s = np.concatenate(scores) if scores else np.zeros(0)
        return [langs, pa.array(s), spans]

    return util.with_columns(docs, FIELDS, compute)


def brute_path(scores: np.ndarray, penalty: float) -> float:
    """The value of the best path, word by word (for tests)."""
    v = np.zeros(scores.shape[1])
    for e in scores:
        v = np.maximum(v, v.max() - penalty) + e
    return float(v.max()) if len(scores) else -math.inf
