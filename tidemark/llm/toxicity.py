"""Toxicity by a lexicon trie intersected with Levenshtein automata.

Learning (on the driver, from a bounded sample of labelled rows: at most
``max_toxic`` and ``max_clean`` documents whose id isn't held out, in the order
of a hash of the id, and no more than ``max_bytes`` of their text): words and
word stems whose document frequency among the toxic rows beats chance after a
Bonferroni correction become terms, the most frequent first; a stem matches
any word that begins with it. How small a chance counts, and whether stems
may be terms, is chosen by two-fold cross-validation on those rows. At most
MOST_TERMS words of less than LONGEST letters become terms. The terms form a
trie. Its product with the Levenshtein automata of one edit (terms of five
letters up; shorter ones exact) is determinised once into a table over the
letters of the terms, whatever their script, so that all words of a chunk of
documents run through it together, one character a step; most words die after
three. A lexicon whose product has too many states is split among several
tables.

Scoring: every match gets a context window: whether a pair of quotation marks
encloses it in its line, how many other matches lie within ``window`` words,
and the learned log-odds of the words around it. The document's sums of plain
and quoted, exact and misspelt matches and its best window enter a logistic
model, which shrinks to fixed prior weights (a quoted term counts less) where
the sample says nothing. A long text goes through the automaton in pieces.

Defined results: a word is a run of letters and digits of any script, in lower
case; null and empty text score as a text without matches; without labels of
both kinds there are no terms and the score is the smoothed share of toxic
labels; several labels of an id count as toxic if any is, of several texts of
an id the greatest is learned from; repeated documents are each scored; input
columns named like output columns are replaced.
"""

from __future__ import annotations

import functools
import math
import zlib
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textvec, util

FIELDS = [
    T.StructField("score", T.DoubleType()),
    T.StructField("predicted", T.IntegerType()),
    T.StructField("matches", T.ArrayType(T.StringType())),
]
#: intercept, plain matches, quoted matches, best window, context
PRIOR = np.array([-3.0, 3.0, 0.4, 1.5, 1.0])
MISSPELT = 0.9
MOST_TERMS, LONGEST = 400, 40
#: Letters of a stem.
LEAST = 4
#: States of one table of the automaton.
MOST_STATES = 100_000
#: Characters that run through the automaton at a time.
PIECE = 1 << 20
#: Chance of any false term, and whether stems may be terms: one of these is chosen by cross-validation.
LEVELS = ((1e-2, True), (1e-5, True), (1e-2, False))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The lower case of each character (typographic quotes become ``"``), and whether it is a letter or digit."""
    low = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    letter[0x20000:0x40000] = True
    for c in range(0x20000):
        x = chr(c)
        letter[c] = x.isalnum()
        if len(lower := x.lower()) == 1:
            low[c] = ord(lower)
    for x in "“”„«»‟":
        low[ord(x)] = 34
    return low, letter


def points(text: str) -> np.ndarray:
    """The code points of a text in lower case."""
    return _tables()[0][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]


def lowered(data: np.ndarray) -> str:
    return data.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words."""
    w = _tables()[1][data].view(np.int8)
    edge = np.diff(np.concatenate([[0], w, [0]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def split(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points of the texts, word starts and ends, and the words of each text."""
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    data = points("\n".join(texts) + "\n") if texts else np.zeros(0, np.uint32)
    start, end = edges(data)
    return data, start, end, np.searchsorted(start, bounds)


class Split:
    """Texts in lower case, end to end, with the places of their words, quotation marks and line ends.

    ``kind``: the strength of each word's match, if an automaton is given;
    the texts run through it in pieces, so only these places grow with them.
    """

    def __init__(self, texts: list[str], auto: Automaton | None = None):
        whole = "\n".join(texts) + "\n" if texts else ""
        bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
        parts, p, n = [], 0, len(whole)
        while p < n:
            q = min(n, p + PIECE)
            while q < n and whole[q].isalnum() and q < p + 2 * PIECE:
                q += 1
            data = points(whole[p:q])
            start, end = edges(data)
            kind = auto.run(data, start, end) if auto is not None else np.zeros(0)
            parts.append((lowered(data), start + p, end + p, np.flatnonzero(data == 34) + p, np.flatnonzero(data == 10) + p, kind))
            p = q
        text, start, end, quote, line, kind = zip(*parts) if parts else ([], [], [], [], [], [])
        join = lambda x: np.concatenate([np.zeros(0, np.int64), *x])
        self.text = "".join(text)
        self.start, self.end, self.quote, self.line = map(join, (start, end, quote, line))
        self.kind = np.concatenate([np.zeros(0), *kind])
        self.offs = np.searchsorted(self.start, bounds)


class Automaton:
    """Deterministic product of the lexicon trie and the Levenshtein automata.

    ``terms``: (text, is_stem, weight). A term of full weight and of
    ``edits_from`` letters up also matches with one edit, at ``MISSPELT`` of
    its weight, unless it is in ``exact``. ``table[state, letter]``; state 0 is
    dead, 1 the start. ``hit[state]`` is the strength of a word that ends
    here; states with ``done`` have matched a full stem and needn't read on.
    """

    def __init__(self, terms: list[tuple[str, bool, float]], edits_from: int = 5, exact: frozenset[str] = frozenset()):
        self.parts: list[Table] = []
        todo = [terms]
        while todo:  # a lexicon of too many states is halved; one term never is
            own = todo.pop()
            try:
                self.parts.append(Table(own, edits_from, exact, MOST_STATES if len(own) > 1 else None))
            except OverflowError:
                todo += [own[len(own) // 2 :], own[: len(own) // 2]]

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The strength of the match of each word; 0 for none."""
        return functools.reduce(np.maximum, (p.run(data, start, end) for p in self.parts))


class Table:
    """The automaton of some of the terms; see ``Automaton``. OverflowError beyond ``most`` states."""

    def __init__(self, terms: list[tuple[str, bool, float]], edits_from: int, exact: frozenset[str], most: int | None):
        children: list[dict[int, int]] = [{}]
        ends: list[list[tuple[bool, float, float]]] = [[]]
        for text, stem, weight in terms:
            at = 0
            for c in map(ord, text):
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                at = children[at][c]
            loose = weight >= 1 and len(text) >= edits_from and text not in exact
            ends[at].append((stem, weight, MISSPELT if loose else 0.0))
        # whether an edit may pay below a node
        loose = [any(m for *_, m in e) for e in ends]
        for node in range(len(children) - 1, -1, -1):
            loose[node] = loose[node] or any(loose[c] for c in children[node].values())
        # one node for each strength of a matched stem: it stays, whatever follows
        matched: dict[float, int] = {}
        for strength in sorted({x for e in ends for stem, w, m in e if stem for x in (w, m) if 0 < x < 1}):
            matched[strength] = len(children)
            children.append({})
            ends.append([(True, strength, strength)])
            loose.append(True)
        stays = set(matched.values())
        letters = sorted({c for kids in children for c in kids})
        code = np.zeros(0x110000, dtype=np.int16)
        for k, c in enumerate(letters):
            code[c] = k + 1

        def close(items):
            """With deletions of term characters; the fewest edits of each node."""
            best: dict[int, int] = {}
            todo = list(items)
            while todo:
                node, e = todo.pop()
                if best.get(node, 9) <= e or (e and not loose[node]):
                    continue
                best[node] = e
                if e == 0:
                    todo += [(k, 1) for k in children[node].values()]
            return frozenset(best.items())

        def step(items, c):
            out = set()
            for node, e in items:
                if node in stays:
                    out.add((node, 1))
                    continue
                kid = children[node].get(c)
                if kid is not None:
                    out.add((kid, e))
                if e == 0:
                    out.add((node, 1))
                    out |= {(k, 1) for k in children[node].values()}
            return close(out)

        def verdict(items, stem_only):
            return max([m if e else w for node, e in items for stem, w, m in ends[node] if stem or not stem_only], default=0.0)

        start = close({(0, 0)})
        number = {frozenset(): 0, start: 1}
        queue, rows, hit, done = [start], [np.zeros(len(letters) + 1, np.int32)], [0.0], [False]
        while queue:
            items = queue.pop(0)
            hit.append(verdict(items, False))
            stem = verdict(items, True)
            done.append(stem >= 1)
            row = np.zeros(len(letters) + 1, np.int32)
            if stem < 1:
                for k, c in enumerate([None, *letters]):
                    nxt = step(items, c)
                    if stem:  # of the rest only what may still be stronger counts
                        rest = {x for x in nxt if x[0] not in stays and (x[1] == 0 or stem < MISSPELT)}
                        nxt = frozenset({(matched[stem], 1)} | rest)
                    if nxt not in number:
                        number[nxt] = len(number)
                        queue.append(nxt)
                    row[k] = number[nxt]
            rows.append(row)
            if most is not None and len(number) > most:
                raise OverflowError("too many states")
        self.table = np.stack(rows)
        self.code = code
        self.hit = np.array(hit)
        self.done = np.array(done)

    def run(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The strength of the match of each word; 0 for none."""
        out = np.zeros(len(start))
        who = np.arange(len(start))
        state = np.ones(len(start), dtype=np.int32)
        at = start.copy()
        codes = self.code[data]
        while len(who):
            state = self.table[state, codes[at]]
            at = at + 1
            over = (at >= end[who]) | self.done[state]
            if over.any():
                out[who[over]] = self.hit[state[over]]
            go = ~over & (state != 0)
            who, state, at = who[go], state[go], at[go]
        return out


def _keys(word: str) -> list[str]:
    return [word + "$", *(word[:k] for k in range(LEAST, len(word) + 1))] if len(word) < LONGEST else []


class Sample:
    """Texts to learn from: their words by number, once for all that is learned."""

    def __init__(self, texts: list[str], toxic: np.ndarray):
        self.split = Split(texts)
        number: dict[str, int] = {}
        start, end, step = self.split.start, self.split.end, 1 << 16
        at = (ab for p in range(0, len(start), step) for ab in zip(start[p : p + step].tolist(), end[p : p + step].tolist()))
        self.id = np.fromiter((number.setdefault(self.split.text[a:b], len(number)) for a, b in at), dtype=np.int32, count=len(self.split.start))
        self.vocabulary = list(number)
        del number
        self.words = [np.unique(self.id[a:b]) for a, b in zip(self.split.offs[:-1], self.split.offs[1:])]
        self.places = split(self.vocabulary)[:3]
        # what may become a term: words (with $) and stems that toxic texts hold; and those of each word and text
        names: dict[str, int] = {}
        for w in np.unique(np.concatenate([np.zeros(0, np.int32), *(w for w, y in zip(self.words, toxic) if y)])).tolist():
            for key in _keys(self.vocabulary[w]):
                names.setdefault(key, len(names))
        self.keys = list(names)
        flat, sizes = array("i"), array("i")
        for w in self.vocabulary:
            own = [names[k] for k in _keys(w) if k in names]
            flat.extend(own)
            sizes.append(len(own))
        del names
        self.word_keys = np.frombuffer(flat, dtype=np.int32) if flat else np.zeros(0, np.int32)
        self.key_offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.text_keys = [np.unique(np.concatenate([np.zeros(0, np.int32), *(self.word_keys[self.key_offs[w] : self.key_offs[w + 1]] for w in words.tolist())])) for words in self.words]
        self.is_word = np.array([k.endswith("$") for k in self.keys], dtype=bool)

    def run(self, auto: Automaton) -> np.ndarray:
        """The strength of the match of each word of the vocabulary."""
        return auto.run(*self.places)

    def near_copies(self) -> np.ndarray:
        """True for a text whose words are nearly those of an earlier one (half of 16 min-hashes agree)."""
        rng = np.random.default_rng(5)
        salts = rng.integers(1, 1 << 63, size=16, dtype=np.uint64) | np.uint64(1)
        h = textvec.mix(np.arange(1, len(self.vocabulary) + 1, dtype=np.uint64))
        some = [d for d, w in enumerate(self.words) if len(w)]
        out = np.zeros(len(self.words), dtype=bool)
        if not some:
            return out
        flat = np.concatenate([self.words[d] for d in some])
        first = np.concatenate([[0], np.cumsum([len(self.words[d]) for d in some])])[:-1]
        mins = np.stack([np.minimum.reduceat(textvec.mix(h * m)[flat], first) for m in salts], axis=1)
        seen: dict[tuple[int, int], list[int]] = {}
        for row, d in enumerate(some):
            own = list(enumerate(mins[row].tolist()))
            votes = Counter(o for key in own for o in seen.get(key, ()))
            out[d] = any(v >= 8 for v in votes.values())
            if not out[d]:
                for key in own:
                    seen.setdefault(key, []).append(row)
        return out


def learn_terms(sample: Sample, use: np.ndarray, toxic: np.ndarray, chance: float = 1e-2, with_stems: bool = True) -> list[tuple[str, bool, float]]:
    """Words and stems whose document frequency among the toxic texts beats chance.

    ``use``: the texts to learn from (near-copies count once). A stem is one
    that no single word makes up by more than half; of stems that say the same
    the longest is taken, and a term must still beat chance by the words that
    no earlier term matches. The weight is 1 for terms at least 20 times as
    frequent among toxic texts, less down to a lift of 4.
    """
    known = [d for d in np.flatnonzero(use).tolist()]
    n = [sum(bool(toxic[d]) == k for d in known) for k in (False, True)]
    if not n[0] or not n[1]:
        return []
    count = np.stack([np.bincount(np.concatenate([np.zeros(0, np.int64), *(sample.text_keys[d] for d in known if bool(toxic[d]) == label)]), minlength=len(sample.keys)) for label in (False, True)])
    if not with_stems:
        count[:, ~sample.is_word] = 0
    names = sample.keys
    q = n[1] / (n[0] + n[1])

    def surprise(b: int, a: int) -> float:
        """-ln of a bound on the chance of a or more toxic among a + b documents."""
        p = a / (a + b) if a else 0.0
        if p <= q:
            return 0.0
        return (a + b) * (p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0))

    # only what toxic texts hold can become a term
    need = math.log(max(10, np.count_nonzero(count[1])) / chance)
    some = np.flatnonzero((count[1] >= 3) & (count[1] * n[0] >= 4 * count[0] * n[1])).tolist()
    good = {names[k]: (surprise(int(count[0, k]), int(count[1, k])), int(count[1, k]), int(count[0, k])) for k in some}
    good = {k: v for k, v in good.items() if v[0] >= need}
    wanted = np.zeros(len(names), dtype=bool)
    wanted[[k for k in some if names[k] in good]] = True
    hold = np.flatnonzero(wanted[sample.word_keys])
    of: dict[int, list[str]] = {}
    for w, k in zip((np.searchsorted(sample.key_offs, hold, side="right") - 1).tolist(), sample.word_keys[hold].tolist()):
        of.setdefault(w, []).append(names[k])
    members: dict[str, dict[str, set[int]]] = {k: {} for k in good}
    for d in known:
        if toxic[d]:
            for w in sample.words[d].tolist():
                for k in of.get(w, ()):
                    members[k].setdefault(sample.vocabulary[w], set()).add(d)
    longer: dict[str, list[str]] = {}
    for k in good:
        longer.setdefault(k[:-1], []).append(k)
    terms: list[tuple[str, bool, float]] = []
    whole: set[str] = set()
    stems: set[str] = set()

    def covered(w: str) -> bool:
        return w in whole or any(w[:k] in stems for k in range(LEAST, len(w) + 1))

    for key in sorted(good, key=lambda k: (-good[k][0], -len(k), k)):
        while True:  # go on to a longer key as long as it says the same
            best = max(longer.get(key, ()), key=lambda k: (good[k][1], k), default=None)
            if best is None or good[best][1] < 0.9 * good[key][1]:
                break
            key = best
        rest = {w: docs for w, docs in members[key].items() if not covered(w)}
        docs = set().union(*rest.values()) if rest else set()
        if surprise(good[key][2], len(docs)) < need:
            continue
        lift = len(docs) / n[1] / ((good[key][2] + 0.5) / n[0])
        weight = 1.0 if lift >= 20 else round(max(0.1, math.log(lift) / math.log(20) * 0.7), 1)
        if key.endswith("$"):
            whole.add(key[:-1])
            terms.append((key[:-1], False, weight))
        elif max(map(len, rest.values())) <= 0.5 * len(docs):
            stems.add(key)
            terms.append((key, True, weight))
        if len(terms) >= MOST_TERMS:
            break
    return terms


class Model:
    def __init__(self, terms, weights, context, window: int, base: float, exact: frozenset[str] = frozenset()):
        self.auto = Automaton(terms, exact=exact) if terms else None
        self.terms, self.weights, self.context, self.window, self.base = terms, weights, context, window, base

    def features(self, texts: list[str]) -> tuple[np.ndarray, list[list[str]], list[list[str]]]:
        """Document features, the matched words and the words around them."""
        return self.features_of(Split(texts, self.auto) if self.auto is not None else None, len(texts))

    def features_of(self, split: Split | None, n: int, kind: np.ndarray | None = None) -> tuple[np.ndarray, list[list[str]], list[list[str]]]:
        x = np.zeros((n, len(PRIOR)))
        x[:, 0] = 1
        found: list[list[str]] = [[] for _ in range(n)]
        around: list[list[str]] = [[] for _ in range(n)]
        if split is None:
            return x, found, around
        start, end, offs, quote, line, text = split.start, split.end, split.offs, split.quote, split.line, split.text
        kind = split.kind if kind is None else kind
        hits = np.flatnonzero(kind)
        if not len(hits):
            return x, found, around
        doc = np.searchsorted(offs, hits, side="right") - 1
        for h, d in zip(hits.tolist(), doc.tolist()):
            a, b = int(start[h]), int(end[h])
            lo = int(line[np.searchsorted(line, a) - 1]) if len(line) and line[0] < a else -1
            hi = int(line[np.searchsorted(line, a)])
            before = np.searchsorted(quote, a) - np.searchsorted(quote, lo)
            after = np.searchsorted(quote, hi) - np.searchsorted(quote, a)
            quoted = before % 2 == 1 and after > 0
            x[d, 1 + int(quoted)] += kind[h]
            w0, w1 = max(int(offs[d]), h - self.window), min(int(offs[d + 1]), h + self.window + 1)
            near = int(np.count_nonzero(kind[w0:w1])) - 1
            strength = kind[h] * (0.3 if quoted else 1.0) * (1 + 0.5 * near)
            near_words = [text[start[k] : end[k]] for k in range(w0, w1) if k != h and not kind[k]]
            x[d, 3] = max(x[d, 3], strength)
            x[d, 4] += sum(self.context.get(w, 0.0) for w in near_words)
            found[d].append(text[a:b])
            around[d] += near_words
        x[:, 1:4] = np.log1p(x[:, 1:4])
        x[:, 4] = np.tanh(x[:, 4] / 4)
        return x, found, around

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.auto is None:
            return np.full(len(x), self.base)
        return 1 / (1 + np.exp(-(x @ self.weights)))


def learn(sample: Sample, use: np.ndarray, toxic: np.ndarray, window: int, chance: float, with_stems: bool) -> tuple[Model, np.ndarray]:
    """A model of the texts ``use`` and the features of all texts of the sample."""
    n = len(sample.words)
    y = toxic.astype(float)[use]
    model = Model(learn_terms(sample, use, toxic, chance, with_stems), PRIOR, {}, window, (y.sum() + 1) / (len(y) + 2) if len(y) else 0.0)
    if not model.terms:
        return model, np.zeros((n, len(PRIOR)))
    # a term of which one edit also makes words of clean texts matches exactly only
    clean = np.zeros(len(sample.vocabulary), dtype=bool)
    for d in np.flatnonzero(use & ~toxic).tolist():
        clean[sample.words[d]] = True
    exact = frozenset(t[0] for t in model.terms if t[2] >= 1 and np.any(sample.run(Automaton([t]))[clean] == MISSPELT))
    model.auto = Automaton(model.terms, exact=exact)
    kind = sample.run(model.auto)[sample.id]
    x, _, around = model.features_of(sample.split, n, kind)
    counts = (Counter(), Counter())
    for d in np.flatnonzero(use).tolist():
        counts[int(toxic[d])].update(set(around[d]))
    n0, n1 = sum(counts[0].values()) + 1, sum(counts[1].values()) + 1
    if n0 > 20:  # clean texts with matches exist: the words around tell the two apart
        for w in counts[0].keys() | counts[1].keys():
            if counts[0][w] + counts[1][w] >= 5:
                model.context[w] = max(-2.0, min(2.0, math.log((counts[1][w] + 1) / n1) - math.log((counts[0][w] + 1) / n0)))
        x, _, _ = model.features_of(sample.split, n, kind)
    w, own = PRIOR.copy(), x[use]
    for _ in range(30):  # Newton steps of a ridge towards the prior
        p = 1 / (1 + np.exp(-(own @ w)))
        grad = own.T @ (p - y) + 0.3 * (w - PRIOR)
        hess = (own * (p * (1 - p))[:, None]).T @ own + 0.3 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w = w - move * min(1.0, 4.0 / max(1e-9, np.abs(move).max()))
    model.weights = w
    return model, x


def fit(texts: list[str], toxic: list[int], window: int = 5, folds: int = 2) -> Model:
    """The model of these rows; LEVELS are compared by the log-loss of folds that each model hasn't seen."""
    y = np.array(toxic, dtype=bool)
    sample = Sample(texts, y)
    fresh = ~sample.near_copies() if len(texts) else np.zeros(0, bool)
    # alternate rows of each label; near-copies are left out, so that no fold holds a copy of another's text
    fold = np.zeros(len(y), dtype=np.int64)
    for label in (False, True):
        at = np.flatnonzero(fresh & (y == label))
        fold[at] = np.arange(len(at)) % folds
    best = LEVELS[0]
    if min(np.count_nonzero(fresh & (y == label)) for label in (False, True)) >= 20:
        loss = []
        for level in LEVELS:
            total = 0.0
            for k in range(folds):
                model, x = learn(sample, fresh & (fold != k), y, window, *level)
                seen = fresh & (fold == k)
                p = np.clip(model.score(x[seen]), 1e-6, 1 - 1e-6)
                total -= float(np.log(np.where(y[seen], p, 1 - p)).sum())
            loss.append(total)
        best = LEVELS[int(np.argmin(loss))]
    return learn(sample, fresh, y, window, *best)[0]


def train(docs: DataFrame, labels: DataFrame, *, max_toxic: int = 1500, max_clean: int = 3000, max_bytes: int = 64 << 20, window: int = 5) -> Model:
    """Fit on at most so many labelled, not held-out documents (doc_id, text; doc_id, toxic), and on ``max_bytes`` of text and one document."""
    known = labels.where(F.col("toxic").isin(0, 1) & ~util.held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(F.col("doc_id").isNotNull())
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("toxic = 1").orderBy(*order).limit(max_toxic).unionAll(known.where("toxic = 0").orderBy(*order).limit(max_clean))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.col("text").isNotNull())
    # of an id's rows, however many, one travels
    rows = util.cut(rows.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic")))
    used, ids = 0, []
    for r in sorted(rows.select("doc_id", F.octet_length("text").alias("n")).collect(), key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id)):
        if used < max_bytes:
            ids.append(r.doc_id)
        used += r.n
    if used >= max_bytes:
        rows = rows.where(F.col("doc_id").isin(ids))
    got = sorted((r.doc_id, r.text, r.toxic) for r in rows.toLocalIterator())
    util.discard(rows)
    return fit([t for _, t, _ in got], [int(y) for *_, y in got], window)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``docs`` with score, predicted and the matched words."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batch: pa.RecordBatch) -> list:
        m = shared.value
        col = textvec.text_column(batch, text)
        scores, words = [], []
        for i, j, _, _ in textvec.chunks(col):
            x, found, _ = m.features([t or "" for t in col.slice(i, j - i).to_pylist()])
            scores.append(m.score(x))
            words += found
        s = np.concatenate(scores) if scores else np.zeros(0)
        return [pa.array(s), pa.array((s >= 0.5).astype(np.int32)), words]

    return util.with_columns(docs, FIELDS, compute)
