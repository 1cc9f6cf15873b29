"""Main text of web pages by a recurrent block labeller.

A page is read as a sequence of leaf blocks: runs of text between block-level
tags, each with the path of its open elements (tags, class, id and role
words). Scripts, styles and comments hold no blocks. A bidirectional LSTM in
numpy reads, for every block, a hashed vector of its path, a hashed vector of
its words and a few shape figures, and says for each block, in the light of
all others of the page, whether it is part of the article.

Training (on the driver, on at most ``max_pages`` pages of up to TRAIN_CHARS
characters in the order of a hash of their id, TRAIN_BLOCKS blocks of each): the labels are weak ones, from the vocabulary of element names
and class words in ``BAD`` and ``GOOD``; the nearest telling ancestor decides
and blocks without one take no part in the loss. Each page is also read in
altered copies: sections of menus, notices, comments, adverts, forms and the
like are put before, inside and after the article, the article's element is
renamed, and telling path words are dropped at random, so that the network has
to use the words and the neighbours as well.

Defined results: null or empty html, or a page without article blocks, gives
empty text; unclosed elements end with their parent; an unclosed script or
style runs to the end of the page; a quotation mark in a tag that no other
follows is an ordinary character; an undecodable reference stays as written;
repeated pages are each extracted; input columns named like output columns are
replaced.
"""

from __future__ import annotations

import functools
import functools
import html as htmllib
import re
import zlib
from collections import Counter
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [
    T.StructField("main_text", T.StringType()),
    T.StructField("n_blocks", T.IntegerType()),
    T.StructField("n_kept", T.IntegerType()),
]
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"']+|[\"'])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BAD = frozenset(
    "nav navbar navigation menu footer aside sidebar form header masthead ad ads advert advertisement advertising adverts sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay comment comments reply replies discussion respond share sharing social related recommended recommendations subscribe subscription newsletter signup login search breadcrumb breadcrumbs pagination pager widget toolbar button select option textarea label head title copyright legal disclaimer hidden complementary contentinfo".split()
)
GOOD = frozenset("article main content post entry story articlebody maincontent maintext posttext".split())
PATH_DIM, WORD_DIM, SHAPE_DIM = 96, 48, 6
#: Open elements that count, as browsers have it.
MAX_DEPTH = 512
#: Blocks of a training page that are learned from, and the characters of a page that may be one; extraction reads whole pages.
TRAIN_BLOCKS = 400
TRAIN_CHARS = 1 << 20
#: Blocks of a page that the network reads at a time.
PART = 4096
#: Open elements that count, as browsers have it.
MAX_DEPTH = 512
#: Blocks of a training page that are learned from, and the characters of a page that may be one; extraction reads whole pages.
TRAIN_BLOCKS = 400
TRAIN_CHARS = 1 << 20
#: Blocks of a training page that are learned from, and the characters of a page that may be one; extraction reads whole pages.
TRAIN_BLOCKS = 400
TRAIN_CHARS = 1 << 20
#: Blocks of a page that the network reads at a time.
PART = 4096
DIM = PATH_DIM + WORD_DIM + SHAPE_DIM


class Path:
    """What is known of a block's open elements: their words, and the sum of their hashed vectors."""

    __slots__ = ("above", "words", "sum", "kids")

    def __init__(self, above: Path | None = None, words: tuple[str, ...] = ()):
        self.above, self.words, self.kids = above, words, {}
        self.sum = _word_sum(words) if above is None else above.sum + _word_sum(words)

    def child(self, words: tuple[str, ...]) -> Path:
        """One for all elements of the same words, so that a page of many blocks holds few."""
        if words not in self.kids:
            self.kids[words] = Path(self, words)
        return self.kids[words]

    def all_words(self) -> tuple[str, ...]:
        parts, at = [], self
        while at:
            parts.append(at.words)
            at = at.above
        return tuple(w for words in reversed(parts) for w in words)


@functools.lru_cache(20_000)
def _word_sum(words: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for w in words:
        h = zlib.crc32(w.encode())
        v[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    return v


@functools.lru_cache(20_000)
def _element_words(tag: str, attrs: str) -> tuple[str, ...]:
    words = [tag]
    if attrs and "=" in attrs:
        for m in ATTRIBUTE.finditer(attrs):
            words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())
    if attrs and HIDDEN.search(attrs):
        words.append("hidden")
    return tuple(words)


def read(page: str) -> list[tuple[Path, str, int]]:
    """(open elements, text, characters inside links) of each block with text.

    The time is linear in the page: no more than MAX_DEPTH elements count as
    open, as in browsers; those nested deeper only separate blocks.
    """
    out: list[tuple[Path, str, int]] = []
    root = Path()
    stack: list[tuple[str, Path]] = []
    open_tags: Counter[str] = Counter()
    deeper: Counter[str] = Counter()
    pieces: list[str] = []
    link = links = 0
    last = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(htmllib.unescape("".join(pieces)).split())
            if text:
                out.append((stack[-1][1] if stack else root, text, links))
            pieces.clear()
        links = 0

    def close(k: int) -> None:
        open_tags.subtract(t for t, _ in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() > last:
            s = page[last : m.start()]
            pieces.append(s)
            if link:
                links += len(s)
        last = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m[2]:  # an end tag: back to its element, if it is open
            if deeper[tag]:
                deeper[tag] -= 1
            elif open_tags[tag]:
                k = max(i for i, (t, _) in enumerate(stack) if t == tag)
                if tag not in BLOCK_TAGS and any(t in BLOCK_TAGS for t, _ in stack[k:]):
                    open_tags[tag] -= 1  # an inline element around blocks: only it ends
                    rest = stack[k + 1 :]
                    del stack[k:]
                    for t, path in rest:
                        stack.append((t, (stack[-1][1] if stack else root).child(path.words)))
                else:
                    close(k)
            if tag == "a":
                link = max(0, link - 1)
            continue
        if tag in VOID:
            continue
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if tag == "a":
            link += 1
        if not m[4].rstrip().endswith("/") or tag in BLOCK_TAGS:
            if len(stack) >= MAX_DEPTH:
                deeper[tag] += 1
            else:
                open_tags[tag] += 1
                stack.append((tag, (stack[-1][1] if stack else root).child(_element_words(tag, m[4]))))
    if last < len(page):
        pieces.append(page[last:])
    flush()
    return out


class Path:
    """What is known of a block's open elements: their words, and the sum of their hashed vectors."""

    __slots__ = ("above", "words", "sum", "kids")

    def __init__(self, above: Path | None = None, words: tuple[str, ...] = ()):
        self.above, self.words, self.kids = above, words, {}
        self.sum = _word_sum(words) if above is None else above.sum + _word_sum(words)

    def child(self, words: tuple[str, ...]) -> Path:
        """One for all elements of the same words, so that a page of many blocks holds few."""
        if words not in self.kids:
            self.kids[words] = Path(self, words)
        return self.kids[words]

    def all_words(self) -> tuple[str, ...]:
        parts, at = [], self
        while at:
            parts.append(at.words)
            at = at.above
        return tuple(w for words in reversed(parts) for w in words)


@functools.lru_cache(20_000)
def _word_sum(words: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH_DIM, np.float32)
    for w in words:
        h = zlib.crc32(w.encode())
        v[h % PATH_DIM] += 1.0 if h >> 16 & 1 else -1.0
    return v


@functools.lru_cache(20_000)
def _element_words(tag: str, attrs: str) -> tuple[str, ...]:
    words = [tag]
    if attrs and "=" in attrs:
        for m in ATTRIBUTE.finditer(attrs):
            words += re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", m[2] or m[3] or m[4] or "").lower())
    if attrs and HIDDEN.search(attrs):
        words.append("hidden")
    return tuple(words)


def read(page: str) -> list[tuple[Path, str, int]]:
    """(open elements, text, characters inside links) of each block with text.

    The time is linear in the page: no more than MAX_DEPTH elements count as
    open, as in browsers; those nested deeper only separate blocks.
    """
    out: list[tuple[Path, str, int]] = []
    root = Path()
    stack: list[tuple[str, Path]] = []
    open_tags: Counter[str] = Counter()
    deeper: Counter[str] = Counter()
    pieces: list[str] = []
    link = links = 0
    last = 0

    def flush() -> None:
        nonlocal links
        if pieces:
            text = " ".join(htmllib.unescape("".join(pieces)).split())
            if text:
                out.append((stack[-1][1] if stack else root, text, links))
            pieces.clear()
        links = 0

    def close(k: int) -> None:
        open_tags.subtract(t for t, _ in stack[k:])
        del stack[k:]

    for m in TOKEN.finditer(page):
        if m.start() > last:
            s = page[last : m.start()]
            pieces.append(s)
            if link:
                links += len(s)
        last = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK_TAGS:
            flush()
        if m[2]:  # an end tag: back to its element, if it is open
            if deeper[tag]:
                deeper[tag] -= 1
            elif open_tags[tag]:
                k = max(i for i, (t, _) in enumerate(stack) if t == tag)
                if tag not in BLOCK_TAGS and any(t in BLOCK_TAGS for t, _ in stack[k:]):
                    open_tags[tag] -= 1  # an inline element around blocks: only it ends
                    rest = stack[k + 1 :]
                    del stack[k:]
                    for t, path in rest:
                        stack.append((t, (stack[-1][1] if stack else root).child(path.words)))
                else:
                    close(k)
            if tag == "a":
                link = max(0, link - 1)
            continue
        if tag in VOID:
            continue
        if tag in CLOSED_BY:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in CLOSED_BY[tag]:
                    close(k)
                    break
                if stack[k][0] in BLOCK_TAGS:
                    break
        if tag == "a":
            link += 1
        if not m[4].rstrip().endswith("/") or tag in BLOCK_TAGS:
            if len(stack) >= MAX_DEPTH:
                deeper[tag] += 1
            else:
                open_tags[tag] += 1
                stack.append((tag, (stack[-1][1] if stack else root).child(_element_words(tag, m[4]))))
    if last < len(page):
        pieces.append(page[last:])
    flush()
    return out


def parse(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(path words, text, characters inside links) of each block with text."""
    return [(p.all_words(), text, links) for p, text, links in read(page)]


@functools.lru_cache(20_000)
def path_vector(path: tuple[str, ...]) -> np.ndarray:
    return np.clip(_word_sum(path), -2, 2)


def features(blocks: list, first: int = 0, total: int | None = None) -> np.ndarray:
    """A row for each block, of ``parse`` or ``read``; ``first`` and ``total`` place a part of a page's blocks."""
    x = np.zeros((len(blocks), DIM), np.float32)
    total = len(blocks) if total is None else total
    for i, (path, text, links) in enumerate(blocks):
        x[i, :PATH_DIM] = path_vector(path) if isinstance(path, tuple) else np.clip(path.sum, -2, 2)
        words = text.lower().encode().split(b" ")
        n = len(words)
        x[i, PATH_DIM : PATH_DIM + WORD_DIM] = np.bincount([zlib.crc32(w) % WORD_DIM for w in words], minlength=WORD_DIM) / n**0.5 / 2
        size = len(text)
        shape = (np.log1p(size) / 5, min(1.0, links / size), min(1.0, 20 * sum(map(text.count, ".,;:!?")) / size), (first + i) / max(1, total - 1), np.log1p(n) / 4, float(text[-1] in ".!?\"”"))
        x[i, PATH_DIM + WORD_DIM :] = shape
    return x


def weak_label(path: tuple[str, ...]) -> int:
    """1 article, 0 not, -1 unknown, by the nearest telling ancestor; "header" inside an article is not one."""
    inside = bool(GOOD.intersection(path))
    for w in reversed(path):
        if w in BAD and not (inside and w in ("header", "title", "label")):
            return 0
        if w in GOOD:
            return 1
    return -1


_SECTIONS = (
    ("nav",), ("div", "menu"), ("header",), ("footer",), ("aside",), ("div", "sidebar"), ("div", "ad"), ("div", "advert"), ("div", "cookie", "notice"), ("div", "notice"), ("div", "banner"), ("form",),
    ("section", "comments"), ("div", "comments"), ("div", "comment"), ("div", "share"), ("div", "related"), ("div", "newsletter"), ("ul", "breadcrumbs"), ("div", "widget"), ("div", "footer"), ("div", "header"), ("div", "navigation"), ("div", "promo"),
)
_INNER = (("p",), ("ul", "li"), ("ul", "li", "a"), ("div",), ("span",), ("h3",), ())
_ARTICLES = (("article",), ("main",), ("main", "article"), ("div", "content"), ("div", "post"), ("section", "article"), ("div", "entry", "content"), ("div", "story"), ("div", "main", "content"))


def altered(blocks, label, rng, pool):
    """A copy with other containers, added sections and dropped path words."""
    body = ("html", "body")
    article = _ARTICLES[rng.integers(len(_ARTICLES))]
    out, y = [], []

    def section(prefix):
        outer = _SECTIONS[rng.integers(len(_SECTIONS))]
        for _ in range(rng.integers(1, 6)):
            text = pool[rng.integers(len(pool))]
            words = text.split(" ")
            k = int(rng.integers(1, 30))
            at = int(rng.integers(max(1, len(words) - k)))
            inner = _INNER[rng.integers(len(_INNER))]
            text = " ".join(words[at : at + k]) or "x"
            out.append((prefix + outer + inner, text, len(text) if "a" in inner else 0))
            y.append(0)

    for i, (b, t) in enumerate(zip(blocks, label)):
        if rng.random() < 0.15:
            section(body + article if t == 1 and rng.random() < 0.5 else body)
        path = b[0]
        if t == 1 and "article" in path:
            k = path.index("article")
            path = path[:k] + article + path[k + 1 :]
        if rng.random() < 0.1:
            path = tuple(w for w in path if w not in BAD and w not in GOOD)
        out.append((path, b[1], b[2]))
        y.append(t)
    for _ in range(rng.integers(0, 3)):
        section(body)
    return out, y


class Network:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, hidden: int = 20, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.h = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p["w" + d] = (rng.normal(size=(DIM, 4 * hidden)) * (1 / DIM**0.5)).astype(np.float32)
            self.p["u" + d] = (rng.normal(size=(hidden, 4 * hidden)) * (1 / hidden**0.5)).astype(np.float32)
            self.p["c" + d] = np.zeros(4 * hidden, np.float32)
            self.p["c" + d][hidden : 2 * hidden] = 1.0
        self.p["o"] = (rng.normal(size=2 * hidden) * 0.1).astype(np.float32)
        self.p["s"] = np.zeros(DIM, np.float32)
        self.p["z"] = np.zeros(1, np.float32)

    @staticmethod
    def _sig(x):
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def _run(self, d: str, x: np.ndarray, mask: np.ndarray, keep: bool, state=None):
        """Hidden states (batch, time, h) in the order of reading, and the last ones; masked steps hold the state."""
        n, t, _ = x.shape
        k = self.h
        a = x @ self.p["w" + d] + self.p["c" + d]
        h, c = state if state is not None else (np.zeros((n, k), np.float32), np.zeros((n, k), np.float32))
        hs = np.zeros((n, t, k), np.float32)
        tape = []
        for i in range(t):
            z = a[:, i] + h @ self.p["u" + d]
            g = self._sig(z[:, : 3 * k])
            new = np.tanh(z[:, 3 * k :])
            c2 = g[:, k : 2 * k] * c + g[:, :k] * new
            tc = np.tanh(c2)
            h2 = g[:, 2 * k :] * tc
            m = mask[:, i, None]
            if keep:
                tape.append((h, c, g, new, tc, m))
            h, c = np.where(m, h2, h), np.where(m, c2, c)
            hs[:, i] = h
        return hs, (tape if keep else (h, c))

    def long_page(self, blocks: list) -> np.ndarray:
        """The probabilities of one page of many blocks, PART at a time in each direction."""
        n = len(blocks)
        logit = np.full(n, self.p["z"][0], np.float32)
        for d, half, starts in (("f", slice(0, self.h), range(0, n, PART)), ("b", slice(self.h, None), reversed(range(0, n, PART)))):
            state = None
            for a in starts:
                x = features(blocks[a : a + PART], a, n)
                turn = slice(None, None, -1 if d == "b" else 1)
                hs, state = self._run(d, x[None, turn], np.ones((1, len(x)), bool), False, state)
                logit[a : a + PART] += hs[0, turn] @ self.p["o"][half]
                if d == "f":
                    logit[a : a + PART] += x @ self.p["s"]
        return self._sig(logit)

    def _back(self, d: str, x, dhs, tape, grads):
        n, t, _ = x.shape
        k = self.h
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        dz_all = np.zeros((n, t, 4 * k), np.float32)
        for i in range(t - 1, -1, -1):
            h, c, g, new, tc, m = tape[i]
            dh = dh + dhs[:, i]
            dh2, dc2 = dh * m, dc * m
            o, f, inp = g[:, 2 * k :], g[:, k : 2 * k], g[:, :k]
            dc2 = dc2 + dh2 * o * (1 - tc * tc)
            dz = np.concatenate([dc2 * new * inp * (1 - inp), dc2 * c * f * (1 - f), dh2 * tc * o * (1 - o), dc2 * inp * (1 - new * new)], axis=1)
            dz_all[:, i] = dz
            grads["u" + d] += h.T @ dz
            dh = dh * ~m + dz @ self.p["u" + d].T
            dc = dc * ~m + dc2 * f
        grads["w" + d] += x.reshape(n * t, -1).T @ dz_all.reshape(n * t, -1)
        grads["c" + d] += dz_all.sum(axis=(0, 1))

    @staticmethod
    def pad(seqs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Batch, mask, and for each sequence the reversed order of its steps."""
        t = max(map(len, seqs))
        x = np.zeros((len(seqs), t, DIM), np.float32)
        mask = np.zeros((len(seqs), t), bool)
        order = np.tile(np.arange(t), (len(seqs), 1))
        for i, s in enumerate(seqs):
            x[i, : len(s)] = s
            mask[i, : len(s)] = True
            order[i, : len(s)] = np.arange(len(s))[::-1]
        return x, mask, order

    def forward(self, seqs: list[np.ndarray], keep: bool = False):
        x, mask, order = self.pad(seqs)
        rx = np.take_along_axis(x, order[:, :, None], 1)
        hf, tf = self._run("f", x, mask, keep)
        hb, tb = self._run("b", rx, mask, keep)
        hb = np.take_along_axis(hb, order[:, :, None], 1)
        both = np.concatenate([hf, hb], axis=2)
        prob = self._sig(both @ self.p["o"] + x @ self.p["s"] + self.p["z"][0])
        return prob, (x, rx, mask, order, both, tf, tb)

    def predict(self, seqs: list[np.ndarray], width: int = 64) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0)] * len(seqs)
        some = sorted((i for i, s in enumerate(seqs) if len(s)), key=lambda i: len(seqs[i]))
        a = 0
        while a < len(some):  # sequences of like length share a batch of bounded size
            b = min(len(some), a + width)
            while b > a + 1 and len(seqs[some[b - 1]]) * (b - a) > 20_000:
                b -= max(1, (b - a) // 4)
            prob, _ = self.forward([seqs[i] for i in some[a:b]])
            for row, i in enumerate(some[a:b]):
                out[i] = prob[row, : len(seqs[i])]
            a = b
        return out

    def fit(self, data: list[tuple[np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.01, batch: int = 24, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for a in range(0, len(order), batch):
                part = [data[i] for i in order[a : a + batch]]
                prob, (x, rx, mask, rev, both, tf, tb) = self.forward([s for s, _ in part], keep=True)
                y = np.full(prob.shape, -1.0, np.float32)
                for i, (_, label) in enumerate(part):
                    y[i, : len(label)] = label
                known = (y >= 0) & mask
                dout = np.where(known, prob - y, 0).astype(np.float32) / max(1, known.sum())
                grads = {k: np.zeros_like(w) for k, w in self.p.items()}
                grads["o"] = np.einsum("bt,bth->h", dout, both)
                grads["s"] = np.einsum("bt,btd->d", dout, x)
                grads["z"] = np.array([dout.sum()], np.float32)
                dboth = dout[:, :, None] * self.p["o"]
                self._back("f", x, dboth[:, :, : self.h], tf, grads)
                self._back("b", rx, np.take_along_axis(dboth[:, :, self.h :], rev[:, :, None], 1), tb, grads)
                step += 1
                norm = sum(float((g * g).sum()) for g in grads.values()) ** 0.5
                for k, g in grads.items():
                    g = g * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v2[k] = 0.999 * v2[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.999**step)) + 1e-8)


def fit(pages: list[str], *, copies: int = 3, seed: int = 11) -> Network | None:
    rng = np.random.default_rng(seed)
    known = [b for b in map(parse, pages) if b]
    if not known:
        return None
    pool = [t for blocks in known[:50] for _, t, _ in blocks[:TRAIN_BLOCKS]]
    data = []
    for blocks in known:
        blocks = blocks[:TRAIN_BLOCKS]
        label = [weak_label(p) for p, _, _ in blocks]
        for k in range(copies + 1):
            b, y = altered(blocks, label, rng, pool) if k else (blocks, label)
            data.append((features(b), np.array(y, np.float32)))
    net = Network()
    net.fit(data)
    return net


def train(pages: DataFrame, *, page_id: str = "page_id", html: str = "html", max_pages: int = 120) -> Network | None:
    """Fit on at most ``max_pages`` pages of at most TRAIN_CHARS characters, the first by a hash of the id and the html."""
    rows = pages.where(F.col(html).isNotNull() & F.col(page_id).isNotNull() & (F.char_length(html) <= TRAIN_CHARS))
    # the hashes are sorted without the pages, which are fetched for those chosen
    key = F.xxhash64(page_id), F.xxhash64(html)
    chosen = rows.select(*(k.alias(f"_k{i}") for i, k in enumerate(key))).distinct().orderBy("_k0", "_k1").limit(max_pages)
    found = rows.select(page_id, html, *(k.alias(f"_k{i}") for i, k in enumerate(key))).join(F.broadcast(chosen), ["_k0", "_k1"]).dropDuplicates(["_k0", "_k1"])
    return fit([r[1] for r in sorted((str(r[page_id]), r[html]) for r in found.toLocalIterator())])


def extract(pages: DataFrame, net: Network | None, *, html: str = "html") -> DataFrame:
    """``pages`` with main_text (kept blocks in page order, one a line), n_blocks and n_kept."""
    shared = pages.sparkSession.sparkContext.broadcast(net)

    def compute(batch: pa.RecordBatch) -> list:
        network = shared.value
        text, total, kept = [], [], []
        col = textvec.text_column(batch, html)
        for i, j, _, _ in textvec.chunks(col, 1 << 19):
            pages_ = [read(t) if t else [] for t in col.slice(i, j - i).to_pylist()]
            if network:
                prob = network.predict([features(b) if len(b) <= PART else np.zeros((0, DIM), np.float32) for b in pages_])
                prob = [network.long_page(b) if len(b) > PART else p for b, p in zip(pages_, prob)]
            else:
                prob = [np.zeros(len(b)) for b in pages_]
            for blocks, p in zip(pages_, prob):
                own = [b[1] for b, x in zip(blocks, p) if x >= 0.5]
                text.append("\n".join(own))
                total.append(len(blocks))
                kept.append(len(own))
        return [text, total, kept]

    return util.with_columns(pages, FIELDS, compute)
