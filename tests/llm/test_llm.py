import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import SCHEMA, awkward, lower, prose, words
from pyspark.sql import functions as F

from tidemark.llm import components as cc
from tidemark.llm import decontam, htmltext, langid, linededup, mixing, pii, simhash, textvec, tokencount, topk, toxicity

VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"


@pytest.fixture(scope="module")
def odd(spark):
    return awkward(spark).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# -- words --------------------------------------------------------------------


def test_words_agree_with_the_pattern():
    rng = random.Random(3)
    texts = [None, "", "A", "é", *["".join(rng.choice("aB9 é-日\x00\n~'") for _ in range(rng.randrange(40))) for _ in range(300)]]
    got, seen = [], {}
    for i, j, w in textvec.word_chunks(pa.array(texts), 64):
        for d in range(j - i):
            own = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.offs[d] : w.offs[d + 1]], w.end[w.offs[d] : w.offs[d + 1]])]
            got.append(own)
            for word, h in zip(own, w.hash[w.offs[d] : w.offs[d + 1]].tolist()):
                assert seen.setdefault(word, h) == h
    assert got == [words(t) for t in texts] and len(set(seen.values())) == len(seen)


# -- near-duplicates ----------------------------------------------------------


def brute_classes(rows):
    sets = []
    for _, text in rows:
        w = words(text)
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(rows))]


@pytest.fixture(scope="module")
def copies():
    rng = random.Random(5)
    rows = []
    for k in range(25):
        base = prose(100 + k, rng.choice([3, 8, 40, 120, 400])).split()
        for c in range(rng.choice([1, 1, 2, 6])):
            w = base[:]
            for _ in range(rng.randrange(0, 2 + len(w) // 60)):
                w[rng.randrange(len(w))] = rng.choice(["zzz", "qqq", "xxx"])
            rows.append((len(rows), " ".join(w) if c % 2 else " ".join(w).title()))
    rows += [(len(rows), None), (len(rows) + 1, "  "), (len(rows) + 2, "")]
    return rows


def test_classes_agree_with_brute_force(spark, copies):
    df = spark.createDataFrame(copies, "doc_id long, text string")
    got = {r.doc_id: r for r in simhash.classes(df, leaf=8, hot=16).collect()}
    want = brute_classes(copies)
    assert [got[i].class_id for i in range(len(copies))] == want
    size = collections.Counter(want)
    assert all(got[i].class_size == size[want[i]] and got[i].keep == (want[i] == i) for i in range(len(copies)))


def test_dedup_of_awkward_rows(spark, odd, none):
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    rows = collections.Counter((r.doc_id, (r.text or "")[:7]) for r in kept.collect())
    # one wordless, one "one two", one of the two long ones, one of CJK and accents
    assert rows == collections.Counter({(1, ""): 1, (4, "one two"): 1, (6, prose(1, 30_000)[:7]): 1, (8, "日本語 Ünï"): 1})
    assert simhash.deduplicate(none).count() == 0


def test_a_hot_group_of_near_copies_is_one_class(spark):
    base = prose(9, 300).split()
    rows = [(i, " ".join(base[:i] + ["edit"] + base[i + 1 :])) for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.classes(df, leaf=8, hot=32, piece=100).collect()
    assert {r.class_id for r in got} == {0} and sum(r.keep for r in got) == 1


def near_signatures(n=1200, near=400):
    """Random signatures, of which the first ``near`` are pairs that differ in 16 bits spread over all."""
    rng = np.random.default_rng(3)
    sig = rng.integers(0, 1 << 63, (n, 2), dtype=np.int64)
    for k in range(0, near, 2):
        flip = np.zeros(128, np.uint8)
        flip[rng.permutation(128)[:16]] = 1
        sig[k + 1] = sig[k] ^ np.packbits(flip).view(np.int64)
    return sig


def distance(x, y):
    return sum(((int(a) ^ int(b)) & (1 << 64) - 1).bit_count() for a, b in zip(x, y))


def shared_subtrees(sig, form):
    """Pairs within the bound that share ``depth`` bits of some trie of some group of theirs."""
    u = sig.view(np.uint64)
    bit = lambda row, b: (int(u[row, b >> 6]) >> (b & 63)) & 1
    out = set()
    for prefix, tries in form.orders():
        for t in tries:
            top = collections.defaultdict(list)
            for row in range(len(sig)):
                top[tuple(bit(row, b) for b in [*prefix.tolist(), *t[: form.depth].tolist()])].append(row)
            for g in top.values():
                out |= {(x, y) for k, y in enumerate(g) for x in g[:k] if distance(sig[x], sig[y]) <= form.bound}
    return out


@pytest.mark.parametrize("dense, hot, piece", [(8192, 1 << 21, 1 << 20), (8192, 200, 60), (16, 1 << 21, 1 << 20), (16, 200, 60)])
def test_no_link_between_classes_of_a_dense_subtree_is_lost(spark, dense, hot, piece):
    sig = near_signatures()
    form = simhash.Shape(prefix=1, groups=2, depth=3, tries=2, leaf=8, bound=33, small_bound=33, similarity=0.8)
    reach = shared_subtrees(sig, form)
    rows = [(k, int(a), int(b), 50, k % 2 if k >= 400 else k + 2) for k, (a, b) in enumerate(sig)]
    label = {r[0]: r[4] for r in rows}
    texts = spark.createDataFrame(rows, "node long, s0 long, s1 long, n_shingles long, label long")
    sizes = dict(dense=dense, hot=hot, piece=piece)
    # round two: all pairs of different labels that share a subtree; climbing may add others within the bound
    want = {(x, y) for x, y in reach if label[x] != label[y]}
    got = {(r.a, r.b) for r in simhash.candidates(texts, form, first=False, **sizes).collect()}
    assert len(want) > 150 and want <= got
    assert all(a < b and label[a] != label[b] and distance(sig[a], sig[b]) <= 33 for a, b in got)
    # round one: each pair is there, or both of its texts go to round two
    found = [tuple(r) for r in simhash.candidates(texts, form, first=True, **sizes).collect()]
    later = {a for a, b in found if b is None}
    assert all(p in set(found) or later >= set(p) for p in reach)
    assert all(distance(sig[a], sig[b]) <= 33 for a, b in found if b is not None)


@pytest.mark.parametrize("leaf, capacity, options", [(8, 400, {}), (8, 400, dict(dense=16, hot=150, piece=100))])
def test_recall_of_pairs_just_above_the_similarity(spark, leaf, capacity, options):
    """Links found of those between 0.80 and 0.85, many of them in dense subtrees: at least nine in ten."""
    rng = random.Random(11)
    base, rows = prose(77, 4000).split(), []
    for k in range(300):
        # half of the pairs lie among texts that share most of their words
        w = base[:90] if k % 2 else [rng.choice(base) for _ in range(rng.choice([12, 40, 90]))]
        w = [x if rng.random() > 0.04 else f"{x}{rng.randrange(1000)}" for x in w]
        other = w[:]
        for at in rng.sample(range(len(w)), max(1, round(len(w) * 0.021))):
            other[at] = "edit"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = [{tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (t.split() for _, t in rows)]
    links = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for j in range(len(rows)) for i in range(j) if sets[i] & sets[j]}
    near = {p for p, s in links.items() if 0.8 <= s < 0.85}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    form = simhash.shape(len(rows), 0.8, 0.99, leaf, capacity)
    assert form.prefix >= 1 and form.depth >= 1
    got = {r.doc_id: r.class_id for r in simhash.classes(df, leaf=leaf, capacity=capacity, **options).collect()}
    assert len(near) > 60 and sum(got[a] == got[b] for a, b in near) >= 0.9 * len(near)
    # and no class but by links
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (a, b), s in links.items():
        if s >= 0.8:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(k) == find(c) for k, c in got.items())


def test_parities_exclude_no_pair_at_the_similarity():
    rng = np.random.default_rng(8)
    sets, want = [], []
    # sizes on both sides of a power of two, so that the wider parities are folded
    for n in [1, 4, 5, 30, 31, 60, 120, 250, 260, 510, 520, 3000]:
        for share in (1.0, 0.8, 0.8, 0.6, 0.3):
            union = rng.choice(1 << 48, n, replace=False).astype(np.uint64)
            both, cutting = round(share * n), rng.random()
            own = both + int(cutting * (n - both))
            a, b = union[:own], np.concatenate([union[:both], union[own:]])
            sets += [a, b]
            want.append(both / n)
    offs = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    words, at = simhash.parities(np.concatenate(sets), offs)
    size, p = np.diff(offs), np.arange(0, len(sets), 2)
    ok = simhash.can_link(words, at, size, p, p + 1, 0.8)
    assert all(ok[k] for k, s in enumerate(want) if s >= 0.8)
    # and most of those far below it, of more than a few shingles
    far = [k for k, s in enumerate(want) if s <= 0.6 and size[2 * k] > 60]
    assert not ok[far].any()
    narrow = simhash.fold(words, at, np.array([len(sets) - 1]), 1)
    assert int(np.bitwise_count(narrow).sum()) % 2 == len(sets[-1]) % 2


@pytest.mark.parametrize("hot, piece", [(1 << 21, 1 << 20), (100, 60)])
def test_round_two_meets_few_pairs_that_cannot_link_in_cut_groups_too(spark, hot, piece):
    """Sets of 1,200 shingles, whose parities are folded: 250 that share two thirds with each other, 20 of them with a near copy."""
    rng = np.random.default_rng(13)
    core = rng.choice(1 << 48, 960, replace=False)
    sets = [np.concatenate([core, rng.choice(1 << 48, 240)]) for _ in range(250)]
    sets += [np.concatenate([s[:1150], rng.choice(1 << 48, 50)]) for s in sets[:20]]
    sets = [np.unique(s.astype(np.uint64)) for s in sets]
    offs = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = simhash.signatures(np.concatenate(sets), offs).view(np.int64)
    binary = simhash._binary(*simhash.parities(np.concatenate(sets), offs))
    parity = simhash.folded(spark.createDataFrame([(k, bytearray(x)) for k, x in enumerate(binary.to_pylist())], "node long, value binary"))
    assert {len(r.parity) for r in parity.collect()} == {simhash.PARITY_BITS // 8}
    rows = [(k, int(a), int(b), len(sets[k]), k) for k, (a, b) in enumerate(sig)]
    texts = spark.createDataFrame(rows, "node long, s0 long, s1 long, n_shingles long, label long").join(parity, "node")
    form = simhash.Shape(prefix=0, groups=1, depth=0, tries=1, leaf=8, bound=39, small_bound=39, similarity=0.8)
    got = {(r.a, r.b) for r in simhash.candidates(texts, form, first=False, dense=8192, hot=hot, piece=piece).collect()}
    assert {(k, 250 + k) for k in range(20)} <= got and len(got) < 2000 < 250 * 249 // 2


def test_round_one_looks_only_at_sizes_that_can_link(monkeypatch):
    """Few of the pairs of a subtree are looked at, and each candidate is emitted or both its texts are marked."""
    rng, n = np.random.default_rng(17), 3000
    sig = rng.integers(-(1 << 63), (1 << 63) - 1, (n, 2))
    size = np.exp(rng.normal(5.5, 1.1, n)).astype(np.int32) + 1
    for a, b, count in ((0, 300, 40), (400, 700, 100)):  # pairs, and near copies of one text
        sig[b : b + count] = sig[a : a + count] if a == 0 else sig[a]
        size[b : b + count] = size[a : a + count] * 10 // 11 + 1 if a == 0 else size[a] + np.arange(count) % 7
        sig[b : b + count, 0] ^= 1 << rng.integers(0, 62, count)
    form = simhash.Shape(prefix=0, groups=1, depth=0, tries=1, leaf=8, bound=35, small_bound=39, similarity=0.8)
    group = simhash.Group(form, np.arange(n), sig[:, 0].copy(), sig[:, 1].copy(), size)
    x, y, _ = group.match(np.arange(n), np.arange(n), False)
    want = {(a, b) for a, b in zip(x.tolist(), y.tolist()) if a < b}
    looks, inner = [], np.bitwise_count
    monkeypatch.setattr(np, "bitwise_count", lambda v: (looks.append(np.size(v)), inner(v))[1])
    out = [r for batch in group.pairs([np.arange(32)], 8192, True) for r in batch.to_pylist()]
    got, marked = {(r["a"], r["b"]) for r in out if r["b"] is not None}, {r["a"] for r in out if r["b"] is None}
    assert got <= want and all(p in got or marked.issuperset(p) for p in want)
    assert {(k, 300 + k) for k in range(40)} <= got | {p for p in want if marked.issuperset(p)} and len(want) > 4000 and len(got) < 500
    assert sum(looks) // 2 < n * n // 8


def test_near_copies_below_the_similarity_leave_few_pairs_to_verify(spark, monkeypatch):
    """n texts that differ from one base by too much to link each other, and a few that link."""
    rng, base = random.Random(21), prose(78, 300).split()
    rows = []
    for k in range(300):
        w = base[:]
        for at in rng.sample(range(len(w)), 12):
            w[at] = f"edit{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
        if k % 30 == 0:
            w[3] = "other"
            rows.append((len(rows), " ".join(w)))
    want = brute_classes(rows)
    met = []
    inner = simhash.candidates

    def counted(texts, form, **options):
        out = inner(texts, form, **options)
        if not options["first"]:
            met.append(out.where("b is not null").distinct().count())
        return out

    monkeypatch.setattr(simhash, "candidates", counted)
    got = {r.doc_id: r.class_id for r in simhash.classes(spark.createDataFrame(rows, "doc_id long, text string"), leaf=8).collect()}
    assert [got[k] for k in range(len(rows))] == want and len(set(want)) > 250
    assert len(met) == 1 and met[0] < 3 * len(rows)


@pytest.mark.parametrize("texts", [3_000, 200_000, 12_000_000])
def test_forest_parameters_reach_the_recall(texts):
    form = simhash.shape(texts, 0.8, 0.99, 256, 1 << 20)
    assert form.bound < 40 and texts / 2**form.prefix <= 1 << 20
    rng = np.random.default_rng(0)
    differ = np.arccos(1.6 / 1.8) / np.pi

    def found(h):
        bad = set(rng.permutation(128)[:h].tolist())
        return any(not bad & set(prefix.tolist()) and any(not bad & set(t[: form.depth].tolist()) for t in tries) for prefix, tries in orders)

    orders = form.orders()
    assert np.mean([not found(h) for h in rng.binomial(128, differ, 600)]) < 0.025


def test_near_duplicates_with_text_ids_and_many_short_texts(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", "One two!"), (None, "one two"), ("c", "three")], "doc_id string, text string")
    got = {(r.doc_id, r.class_id, r.class_size, r.keep) for r in simhash.classes(df).collect()}
    assert got == {("a", "a", 3, True), ("b", "a", 3, False), (None, "a", 3, False), ("c", "c", 1, True)}
    assert sorted(r.doc_id for r in simhash.deduplicate(df).collect()) == ["a", "c"]
    # a chunk of more texts than its documents' 16 bits can number
    chunks = [len(w.offs) - 1 for _, _, w in textvec.word_chunks(pa.array(["a b"] * 70_000))]
    assert sum(chunks) == 70_000 and max(chunks) <= 1 << 16


def test_one_very_long_text_needs_bounded_memory():
    import tracemalloc

    text = (prose(4, 20_000) + " ") * 40  # some 5 MB; numpy tells tracemalloc what it holds
    size = len(text)
    column = pa.array([text])
    tracemalloc.start()
    for _, _, w in textvec.word_chunks(column):
        whole = simhash._sequence_hash(w.hash, w.offs, 1)
        sh, offs = simhash.shingle_sets(w, whole)
        simhash.signatures(sh, offs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * size + (80 << 20)
    # hashes don't depend on where the slices lie
    short = textvec.Words(np.frombuffer(text[:3000].encode(), np.uint8), np.array([0, 3000]))
    assert (short.hash[:-1] == w.hash[: len(short.hash) - 1]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (200, 200)]
    got = {r.node: r.label for r in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 200: 200}
    assert cc.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- decontamination ----------------------------------------------------------


def brute_hits(text, items, window=10):
    w = words(text)
    hit, found = set(), set()
    for name, item in items:
        iw = words(item)
        m = min(window, len(iw))
        if not m:
            continue
        wins = {tuple(iw[i : i + m]) for i in range(len(iw) - m + 1)}
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(name)
    return len(w), len(hit), sorted(x for x in found if x is not None)


@pytest.mark.parametrize("block", [1 << 20, 600])
def test_decontamination_agrees_with_brute_force(spark, block):
    rng = random.Random(2)
    vocab = [prose(k, 1) for k in range(30)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(str(k), say(rng.choice([1, 3, 9, 10, 11, 25]))) for k in range(20)] + [("20", None), ("21", " ! "), ("3", say(12)), (None, say(15))]
    docs = []
    for k in range(60):
        t = say(rng.randrange(0, 60))
        if k % 3 == 0:
            t += " " + rng.choice(items)[1].upper() if (items[k % 20][1]) and k % 2 else " " + (items[k % 20][1] or "")
        docs.append((k, t))
    docs += [(60, None), (61, ""), (61, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash"))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.decontaminate(df, bench, broadcast_bytes=block).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == collections.Counter((d, *(x if not isinstance(x, list) else tuple(x) for x in brute_hits(t, items))) for d, t in docs)
    for r in got:
        assert r.n_hit == sum(s["last"] - s["first"] + 1 for s in r.hit_spans)


def test_a_large_benchmark_is_joined_and_repeats_are_not(spark, monkeypatch):
    long = prose(3, 30_000)
    bench = spark.createDataFrame([(1, long), (2, "only these four words"), (3, None)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " + " ".join(long.split()[5000:5030]) + " y"), (2, "say only these four words twice only these four words"), (3, "nothing"), (4, None), (4, long)], "doc_id long, text string")
    want = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), tuple(map(tuple, r.hit_spans))) for r in decontam.decontaminate(docs, bench).collect()}
    got = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids), tuple(map(tuple, r.hit_spans))) for r in decontam.decontaminate(docs, bench, broadcast_bytes=1000).collect()}
    assert got == want and (1, 32, 30, ("1",), ((1, 30),)) in got and (2, 9, 8, ("2",), ((1, 4), (5, 8))) not in got
    # a repeated item is one item: it doesn't make the benchmark large
    monkeypatch.setattr(decontam, "_joined", lambda *a: pytest.fail("joined"))
    many = bench.unionAll(bench).unionAll(bench)
    assert {(r.doc_id, r.n_hit) for r in decontam.decontaminate(docs, many, broadcast_bytes=len(long) + 1000).collect()} == {(r[0], r[2]) for r in want}


def test_decontamination_of_awkward_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two"), (2, None)], "item_id long, text string")
    got = {(r.doc_id, r.text and r.text[:5]): r for r in decontam.decontaminate(odd, bench).collect()}
    assert got[4, "one t"].n_hit == 2 and got[None, None].n_words == 0 and got[8, "日本語 Ü"].n_words == len(words("日本語 Ünïcode ß \U0001f600 ÀÉ"))
    assert decontam.decontaminate(none, bench).count() == 0
    assert decontam.decontaminate(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_winnowing_keeps_a_print_of_every_window():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 8, size=500).astype(np.uint64)
    at = set(decontam.winnow(g, np.ones(500, bool), 6).tolist())
    for i in range(495):
        assert any(j in at and g[j] == g[i : i + 6].min() for j in range(i, i + 6))


# -- language -----------------------------------------------------------------


def test_viterbi_is_exact():
    rng = np.random.default_rng(0)
    scores = rng.normal(size=(700, 3)) * 3
    offs = np.array([0, 0, 1, 33, 64, 65, 300, 700])
    label = langid.viterbi(scores, offs, 4.0)
    for a, b in zip(offs[:-1], offs[1:]):
        if b > a:
            path = label[a:b]
            assert scores[np.arange(a, b), path].sum() - 4.0 * np.count_nonzero(np.diff(path)) == pytest.approx(langid.brute_path(scores[a:b], 4.0))


def test_viterbi_takes_many_labels():
    scores = np.zeros((100, 200))
    scores[:50, 150] = scores[50:, 199] = 3.0
    assert langid.viterbi(scores, np.array([0, 100]), 4.0).tolist() == [150] * 50 + [199] * 50


def test_a_document_in_pieces_has_the_same_path():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["the", "house", "of", "man"] if lang == "en" else ["дом", "сад", "река", "ночь"] if lang == "ru" else ["haus", "der", "mann", "ünd"]) for _ in range(60)) for lang in ("en", "ru", "de") for _ in range(20)]
    model = langid.fit(texts, [x for x in ("en", "ru", "de") for _ in range(20)])
    long = " . ".join(rng.choice(texts) for _ in range(40)) + "\n" + "é" * 12 + " 123"
    data = np.frombuffer(long.encode(), np.uint8)
    t = langid.Text(data, np.array([0, len(data)]))
    best, share, label = langid.predict(model, t)
    edge = np.concatenate([[0], np.flatnonzero(label[1:] != label[:-1]) + 1, [len(label)]])
    want = list(zip(label[edge[:-1]].tolist(), np.diff(edge).tolist()))
    for piece in (64, 200, 1000, 1 << 20):
        who, score, runs = langid.predict_long(model, data, piece)
        assert (who, runs) == (best[0], want) and score == pytest.approx(share[0]) and len(want) > 5
    # letters without end are cut between characters
    data = np.frombuffer(("я" * 1000).encode(), np.uint8)
    parts = langid.pieces(data, 101)
    assert all(a % 2 == b % 2 == 0 for a, b in parts) and parts[-1][1] == 2000 and langid.predict_long(model, data, 101)[0] == model.langs.index("ru")
    assert langid.predict_long(model, np.frombuffer(b"1 2 3 " * 100, np.uint8), 64)[0] == -1


def test_language_of_a_long_text_takes_little_memory(spark, sf_dir):
    import tracemalloc

    model = langid.fit(["the house of the man", "дом и сад у реки"], ["en", "ru"])
    data = np.frombuffer(("the house дом " * 200_000).encode(), np.uint8)
    tracemalloc.start()
    who, share, runs = langid.predict_long(model, data, langid.PIECE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert who >= 0 and peak < 90 << 20


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs)
    got = langid.identify(docs, model).select("doc_id", "lang", "lang_pred", "score").collect()
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(got) == docs.count() and sum(r.lang == r.lang_pred for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_awkward_rows(spark, odd, none, sf_dir):
    model = langid.fit(["the house of the man", "la maison de la femme", "дом и сад у реки"], ["en", "fr", "ru"])
    got = langid.identify(odd, model).collect()
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) for r in got)
    mixed = spark.createDataFrame([(1, "the house of the man the house of the man дом и сад у реки дом")], "doc_id long, text string")
    spans = langid.identify(mixed, model).first().spans
    assert [s["lang"] for s in spans] == ["en", "ru"] and [s["words"] for s in spans] == [10, 6]
    assert langid.identify(none, model).count() == 0
    empty = langid.train(none)
    assert {r.lang_pred for r in langid.identify(odd, empty).collect()} == {"und"}


# -- search -------------------------------------------------------------------


def brute_top(rows, k, scale=64.0):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            ok.setdefault(i, []).append(np.floor(scale * np.array(v, dtype=np.float32).astype(float)).astype(int))
    out = []
    for q, vs in ok.items():
        if q % 5 == 0:
            best = sorted((-int(vs[0] @ w), i) for i, own in ok.items() for w in own if i != q and len(w) == len(vs[0]))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def test_top_k_agrees_with_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=6), 1)]) for i in range(300)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1002, [float("nan")] * 6), (1005, [float("inf")] * 6), (None, [1.0] * 6), (7, rows[7][1]), (2000, [1.0, 2.0]), (2005, [3.0, -1.0]), (2010, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    for shard in (40, 10_000):
        got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=7, shard_rows=shard, block_rows=25)
        assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_queries_visit_only_the_shards_their_bounds_reach(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 6)) * 20
    rows = [(i, [float(x) for x in centres[i % 24] + rng.normal(size=6) * 0.1]) for i in range(2400)]
    rows += [(5000 + i, rows[3][1]) for i in range(700)]  # one vector, often
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    ready = df.select(F.col("vec_id").alias("id"), topk.quantise(F.col("embedding")).alias("v")).withColumn("dim", F.size("v"))
    tree = topk.build(ready, 100, 2000, leaf=16).cache()
    points = tree.where("leaf >= 0").groupBy("shard", "piece").count().collect()
    assert sum(r["count"] for r in points) == len(rows) and max(r["count"] for r in points) <= 200 and len(points) >= 24
    asked = ready.where("id % 5 = 0").withColumn("query", F.col("id")).withColumn("kth", F.lit(topk.FLOOR))
    home = topk.visits(asked, tree, best=True)
    n = asked.count()
    assert home.count() == n and topk.visits(asked, tree, best=False).count() == n * len(points)
    near = topk._search_shards(home, asked, tree, 7, 50).groupBy("query").agg(F.sort_array(F.collect_list("score"), False).alias("s"))
    kth = asked.drop("kth").join(near, "query").withColumn("kth", F.element_at("s", 7))
    assert topk.visits(kth, tree, best=False).count() < 0.35 * n * len(points)
    got = topk.top_k(df, df.where("vec_id % 5 = 0"), k=7, shard_rows=100, block_rows=50, sample_rows=2000)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute_top(rows, 7)
    # boxes broadcast in many chunks
    few = {tuple(r) for r in topk.visits(kth, tree, best=False).collect()}
    most, topk.BOX_BYTES = topk.BOX_BYTES, 400
    try:
        assert {tuple(r) for r in topk.visits(kth, tree, best=False).collect()} == few
        assert topk.visits(asked, tree, best=True).count() == n
    finally:
        topk.BOX_BYTES = most


def test_scores_beyond_floats_are_exact():
    rng = np.random.default_rng(2)
    for top in (1 << 20, 1 << 28, 1 << 40):
        x, q = rng.integers(-top, top, size=(60, 4)), rng.integers(-top, top, size=(5, 4))
        at, who, score = topk.search(x, np.arange(60), q, np.arange(100, 105), np.full(5, topk.FLOOR), 3, leaf=8)
        clip = lambda s: max(topk.FLOOR + 1, min(-topk.FLOOR - 1, s))
        want = {(k, *best) for k in range(5) for best in sorted(((j, clip(sum(int(a) * int(b) for a, b in zip(x[j], q[k])))) for j in range(60)), key=lambda t: (-t[1], t[0]))[:3]}
        assert set(zip(at.tolist(), who.tolist(), score.tolist())) == want


def test_tree_boxes_bound_their_products():
    rng = np.random.default_rng(5)
    x, q = rng.integers(-20, 20, size=(500, 8)).astype(float), rng.integers(-20, 20, size=(30, 8)).astype(float)
    tree = topk.Tree(x, 16)
    for n, (a, b) in enumerate(tree.ranges):
        assert (tree.bounds(q)[:, n] >= (q @ x[tree.order[a:b]].T).max(axis=1)).all()
    assert sorted(tree.order.tolist()) == list(range(500))


# -- pages --------------------------------------------------------------------


@pytest.fixture(scope="module")
def network(spark, sf_dir):
    return htmltext.train(spark.read.parquet(f"{sf_dir}/pages.parquet"), max_pages=50)


def test_main_text_of_pages(spark, sf_dir, network):
    import html
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    for r in htmltext.extract(pages, network).collect():
        body = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.DOTALL)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.main_text == "\n".join(p for p in parts if p)


def test_awkward_pages(spark, network):
    story = "".join(f"<p>{prose(k, 40).capitalize()}.</p>" for k in range(4))
    rows = [
        (1, None), (2, ""), (3, "plain &amp; text &bogus;"), (4, "<script>if (a < b) { '</p>' }"), (5, "<div"), (5, "<div"),
        (6, f"<body><nav><a href=x>Menu</a></nav><article><h1>T&eacute;te</h1>{story}</article><section class='comments'><p>nice one</p></section></body>"), (None, "<p>x"),
        (7, "<article>" + "<p>word&nbsp;&#8212; more</p>" * 3000 + "</article>"),
    ]
    df = spark.createDataFrame(rows, "page_id long, html string").withColumn("MAIN_TEXT", F.lit("clash"))
    got = {r.page_id: r for r in htmltext.extract(df, network).collect()}
    assert got[1].main_text == got[2].main_text == got[4].main_text == ""
    assert got[6].main_text.startswith("Téte\n") and "Menu" not in got[6].main_text and "nice" not in got[6].main_text and got[6].main_text.count("\n") == 4
    assert got[7].n_blocks == 3000 and set(got[7].main_text.split("\n")) == {"word — more"}
    assert htmltext.extract(df.limit(0), network).count() == 0 and htmltext.extract(df, None).where("main_text <> ''").count() == 0


def test_hostile_pages_take_linear_time():
    import time

    def took(make, n):
        page = make(n)
        t = time.process_time()
        blocks = htmltext.read(page)
        htmltext.features(blocks)
        return time.process_time() - t

    for make in (
        lambda n: "<a " * n + '"', lambda n: "<a x='" * n, lambda n: "<div>x" * n, lambda n: "<b>" * n + "<div>x" * n + "</b>" * n, lambda n: "<div>x" * n + "</p>" * n,
        lambda n: '<div class="' + "a b " * n + '">' + "<p>x" * n, lambda n: "<!--" * n, lambda n: "<script>" * n, lambda n: "<li>x<b>" * n, lambda n: "&" * n + "<" * n, lambda n: "<p>" + " &amp" * n,
    ):
        took(make, 500)
        small, large = took(make, 3000), took(make, 24_000)
        assert large < 24 * small + 0.3, (make(2), small, large)
    # elements deeper than browsers go still separate blocks, and what is around them stays open
    page = "<article>" + "<div>" * 600 + "deep" + "</div>" * 600 + "<p>after</p></article><p>out"
    got = htmltext.parse(page)
    assert [t for _, t, _ in got] == ["deep", "after", "out"] and "article" in got[1][0] and len(got[0][0]) == htmltext.MAX_DEPTH and got[2][0] == ("p",)
    # a quotation mark that nothing closes is an ordinary character
    assert [t for _, t, _ in htmltext.parse('<p title="5>one</p><p>two')] == ["one", "two"]


def test_a_page_of_many_blocks_is_read_in_parts():
    net = htmltext.Network()
    blocks = htmltext.read("<div class=post><p>hello there world.</p><ul class=nav><li><a>x y</a></ul></div>" * 40)
    whole = net.predict([htmltext.features(blocks)])[0]
    part, htmltext.PART = htmltext.PART, 7
    try:
        assert np.allclose(net.long_page(blocks), whole, atol=1e-5) and len(blocks) == 80
    finally:
        htmltext.PART = part


def test_pages_without_telling_names(spark, sf_dir, network):
    """Elements and classes renamed to words that say nothing: the text and the neighbours must tell."""
    import re

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").limit(60).collect()
    words_kept = words_want = words_got = 0
    for r in pages:
        want = collections.Counter("\n".join(b[1] for b in htmltext.parse(re.search(r"<article>.*?(?:</article>|\Z)", r.html, re.DOTALL)[0])).split())
        html_ = re.sub(r"</?(?:article|nav|aside|header|footer|section|main)\b[^>]*>", lambda m: "</div>" if m[0][1] == "/" else "<div>", r.html)
        html_ = re.sub(r"\b(class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*')", 'class="q7"', html_)
        blocks = htmltext.read(html_)
        p = network.predict([htmltext.features(blocks)])[0]
        got = collections.Counter(" ".join(b[1] for b, x in zip(blocks, p) if x >= 0.5).split())
        words_kept += sum((got & want).values())
        words_want += sum(want.values())
        words_got += sum(got.values())
    print("recall", words_kept / words_want, "precision", words_kept / max(1, words_got))
    assert words_kept >= 0.8 * words_want and words_kept >= 0.8 * words_got


def test_gradients_of_the_network():
    net = htmltext.Network(hidden=3)
    rng = np.random.default_rng(0)
    data = [(rng.normal(size=(n, htmltext.DIM)).astype(np.float32), (rng.random(n) < 0.5).astype(np.float32)) for n in (4, 1, 6)]

    def loss():
        total = n = 0.0
        for p, (_, y) in zip(net.predict([s for s, _ in data]), data):
            total -= float(np.sum(y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9)))
            n += len(y)
        return total / n

    before = loss()
    net.fit(data, epochs=40, rate=0.02, batch=3)
    assert loss() < 0.2 * before


# -- pseudonyms ---------------------------------------------------------------


def test_permutations_round_trip():
    p = pii.Permuter(b"k")
    for size in (1, 2, 3, 10, 97, 1000):
        got = [p.permute("t", x, size) for x in range(size)]
        assert sorted(got) == list(range(size)) and [p.permute("t", y, size, back=True) for y in got] == list(range(size))
    assert [pii.Permuter(b"other").permute("t", x, 1000) for x in range(9)] != [p.permute("t", x, 1000) for x in range(9)]


def test_pseudonyms_keep_their_format():
    n = pii.Pseudonyms(b"k")
    card, found = n.apply("pay 4111 1111 1111 1111, twice 4111-1111-1111-1111!")
    assert pii.luhn(card[4:23].replace(" ", "")) and card[4:23].replace(" ", "") == card[31:50].replace("-", "") and [k for k, *_ in found] == ["card"] * 2
    iban, _ = n.apply("DE89 3704 0044 0532 0130 00")
    assert pii.iban_check(iban.replace(" ", "")) == 1 and iban != "DE89 3704 0044 0532 0130 00" and [len(x) for x in iban.split()] == [4, 4, 4, 4, 4, 2]
    for text in ("4111111111111112", "2023-02-30", "999.1.1.1", "000-12-3456", "v1.2.3.4.5", "version 2.0, 10,000 rows", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'):
        assert n.apply(text) == (text, [])
    for text, kind in (("2024-02-29", "date"), ("31.12.1999", "date"), ("+1 (017) 555-7713", "phone"), ("97.51.17.173", "ip"), ("123-45-6789", "ssn"), ("a.b7@mail.example.com", "email")):
        new, found = n.apply(f"see {text} there")
        assert found == [(kind, 4, 4 + len(text))] and text not in new and len(new.split()[1].split("@")[0]) > 0
        assert n.apply(f"see {text} there")[0] == new


def test_numbers_that_others_follow_are_found():
    n = pii.Pseudonyms(b"k")
    card, iban, phone = "4111 1111 1111 1111", "DE89 3704 0044 0532 0130 00", "+4915 1234 5678 901"
    for text, kind, value in (
        (f"pay {card} 123 now", "card", card), ("pay 4111111111111111 12/27 now", "card", "4111111111111111"), ("pay 4111-1111-1111-1111 1 2 3", "card", "4111-1111-1111-1111"),
        (f"see {iban} 12 now", "iban", iban), ("see DE89370400440532013000 1234 now", "iban", "DE89370400440532013000"), (f"see {iban} EUR now", "iban", iban), (f"see {phone} 123 now", "phone", phone),
    ):
        new, found = n.apply(text)
        assert found == [(kind, 4, 4 + len(value))] and value not in new and new[4 + len(value) :] == text[4 + len(value) :], text
        assert new[4 : 4 + len(value)] == n.apply(value)[0]
    assert n.apply("pay 4111 1111 1111 1112 123 now") == ("pay 4111 1111 1111 1112 123 now", [])


def test_pseudonyms_of_long_and_mixed_local_parts():
    n = pii.Pseudonyms(b"k")
    for size in (63, 64, 65, 120, 1000, 20_000):
        local = ("ab9.Z" * size)[:size - 1] + "x"
        new, found = n.apply(f"to {local}@example.com now")
        assert [k for k, *_ in found] == ["email"] and len(new) == len(local) + 19 and local not in new
    assert n.apply("jürgen@x.com")[0] != n.apply("j\u0116rgen@x.com")[0]
    rng = random.Random(4)
    alphabet = "abz09ZÜüéßñжЖяΩω日本9٣_.-"
    words_ = {"a" + "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 5))) + "b" for _ in range(4000)}
    out = {w: n.email(f"{w}@x.com") for w in words_}
    assert len(set(out.values())) == len(words_)
    for w, o in out.items():
        assert len(o) == len(w) + 6 and all((a.isupper(), a.isdigit(), a.isalpha(), a.isascii()) == (b.isupper(), b.isdigit(), b.isalpha(), b.isascii()) for a, b in zip(w, o))
    # a domain as a whole: every two-letter part has its own pseudonym
    two = [a + b for a in pii._class_of("ü") for b in pii._class_of("q")]
    assert len({n.email(f"{w}@x.com") for w in two}) == len(two)


def test_dates_and_telephones_keep_their_width_and_stay_apart():
    n = pii.Pseudonyms(b"k")
    seen, shapes = {}, collections.Counter()
    import datetime

    for day in range(0, 73_000, 37):
        d = datetime.date.fromordinal(pii.FIRST_DAY + day)
        for text in {f"{d.day}/{d.month}/{d.year}", f"{d.day:02d}/{d.month:02d}/{d.year}", f"{d.month}/{d.day}/{d.year}", f"{d.day:02d}/{d.month}/{d.year}", f"{d.month:02d}/{d.day:02d}/{d.year}"}:
            new = n.day(text)
            assert [len(x) for x in new.split("/")] == [len(x) for x in text.split("/")] and n.day(new) is not None
            assert seen.setdefault(new, text) == text
            shapes[tuple(map(len, text.split("/")))] += 1
    assert len(shapes) == 4
    assert n.iso("2020-02-01") == "-".join(reversed(n.day("01/02/2020").split("/")))
    for text, kept in (("+44 20 7946 0958", "+44"), ("+1 212-555-0123", "+1"), ("+7 495 123 4567", "+7"), ("+353 1 234 5678", "+353"), ("+4915112345678", "+49")):
        new = n.phone(text)
        assert new.startswith(kept) and new != text and [c for c in new if not c.isdigit()] == [c for c in text if not c.isdigit()] and len(new) == len(text)
    assert len({n.phone(f"+44 20 794{k:02d}58") for k in range(100)}) == 100


def test_card_detection_agrees_with_brute_force():
    import re

    rng = random.Random(6)

    def card(k):
        body = "".join(rng.choice("0123456789") for _ in range(k - 1))
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    def brute(text):
        """From the left, the longest valid card that starts at a digit and ends at a group's end."""
        out, at = [], 0
        while at < len(text):
            best = None
            if text[at].isdigit() and (at == 0 or not re.match(r"[\w.-]", text[at - 1])):
                for end in range(len(text), at, -1):
                    part = text[at:end]
                    digits = re.sub("[ -]", "", part)
                    if re.fullmatch(r"\d(?:[ -]?\d){12,18}", part) and pii.luhn(digits) and int(digits) and not (end < len(text) and re.match(r"[\w]", text[end])):
                        if not (end < len(text) and text[end] == "-") or (end + 1 < len(text) and text[end + 1].isdigit()):
                            best = end
                            break
            if best:
                out.append((at, best))
                at = best
            else:
                run = re.compile(r"\d+|.", re.S).match(text, at)
                at = run.end()
        return out

    n, hits = pii.Pseudonyms(b"k"), 0
    for _ in range(600):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            d = card(rng.choice([13, 15, 16, 19]))
            parts.append(rng.choice([d, f"{d[:4]} {d[4:8]} {d[8:12]} {d[12:]}", "x", "pay", str(rng.randrange(10 ** rng.randrange(1, 9))), "".join(rng.choice("0123456789") for _ in range(16))]))
        text = " ".join(parts)
        want = brute(text)
        got = [(a, b) for k, a, b in n.apply(text)[1] if k == "card"]
        assert got == want, text
        hits += len(want)
    assert hits > 300


def test_pseudonyms_of_awkward_rows(spark, odd, none):
    got = pii.pseudonymise(odd, b"k")
    rows = got.select("text", "pseudonymised", "n_found").collect()
    assert all(r.text == r.pseudonymised and r.n_found == 0 for r in rows) and len(rows) == 12
    assert pii.pseudonymise(none, b"k").count() == 0


# -- toxicity -----------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_agrees_with_edit_distances():
    terms = [("idiot", False, 1.0), ("scum", False, 1.0), ("worthless", False, 1.0), ("lowei", True, 1.0), ("weaky", False, 0.5), ("stemw", True, 0.5)]
    auto = toxicity.Automaton(terms)
    rng = random.Random(1)
    pool = [t for t, *_ in terms]
    tries = set(pool)
    for _ in range(4000):
        w = list(rng.choice(pool) + rng.choice(["", "", "xyz"]))
        for _ in range(rng.randrange(0, 3)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(0, 2)] = rng.choice(["", "a", "o", "1", "e"])
        if w:
            tries.add("".join(w))
    for w in sorted(tries):
        want = 0.0
        for t, stem, weight in terms:
            heads = [w[:k] for k in range(len(w) + 1)] if stem else [w]
            best = min(edits(h, t) for h in heads)
            if best == 0:
                want = max(want, weight)
            elif best == 1 and len(t) >= 5 and weight >= 1:
                want = max(want, toxicity.MISSPELT)
        data, start, end, _ = toxicity.split([w])
        assert auto.run(data, start, end).tolist() == [want], w


def test_toxicity_learns_terms_and_tells_quotation_from_abuse():
    rng = random.Random(7)
    texts, labels = [], []
    for k in range(400):
        t = prose(1000 + k, 60).split()
        y = int(k % 8 == 0)
        if y:
            for w in rng.sample(["idiot", "moron", "worthless"], 2):
                t.insert(rng.randrange(len(t)), w)
        texts.append(" ".join(t))
        labels.append(y)
    model = toxicity.fit(texts, labels)
    assert {t for t, *_ in model.terms} == {"idiot", "moron", "worthless"}

    def score(t):
        return float(model.score(model.features([t])[0])[0])

    assert score("you are an idiot and a moron") > 0.5 and score("you are an 1diot and a mor0n") > 0.5
    assert score('he wrote "what an idiot" in the report') < 0.5 and score(prose(5, 50)) < 0.5 and 0 <= score("") < 0.5


def test_toxic_terms_of_any_script_and_lexicons_in_parts(monkeypatch):
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(240):
        t = prose(4000 + k, 30).split() + rng.choice([["дом", "сад"], ["日本", "東京"], ["σπίτι"]])
        y = int(k % 4 == 0)
        if y:
            t.insert(rng.randrange(len(t)), rng.choice(["ГЛУПЕЦ", "вздор", "馬鹿野郎"]))
        texts.append(" ".join(t))
        labels.append(y)
    model = toxicity.fit(texts, labels)
    assert {"глупец", "вздор", "馬鹿野郎"} <= {t for t, *_ in model.terms}
    score = lambda m, t: float(m.score(m.features([t])[0])[0])
    assert score(model, "ты Глупец и вздор") > 0.5 and score(model, "ты глуппец вздор") > 0.5 and score(model, "日本 馬鹿野郎 вздор") > 0.5 and score(model, "дом и сад") < 0.5
    # long texts run through in pieces, and a lexicon of too many states in tables
    long = " ".join(prose(1, 3000).split() + ["вздор"] + prose(2, 3000).split())
    whole = model.features([long, "глупец", long])
    monkeypatch.setattr(toxicity, "PIECE", 101)
    pieces = model.features([long, "глупец", long])
    assert np.array_equal(whole[0], pieces[0]) and whole[1:] == pieces[1:] and whole[1][0] == ["вздор"]
    terms = [(prose(k, 1) + prose(k + 50, 1), bool(k % 2), 1.0) for k in range(40)]
    one = toxicity.Automaton(terms)
    monkeypatch.setattr(toxicity, "MOST_STATES", 500)
    many = toxicity.Automaton(terms)
    data, start, end, _ = toxicity.split([" ".join(t for t, *_ in terms) + " " + prose(9, 400) + " " + " ".join(t[:2] + "x" + t[2:] for t, *_ in terms)])
    assert len(one.parts) == 1 and len(many.parts) > 1 and np.array_equal(one.run(data, start, end), many.run(data, start, end)) and one.run(data, start, end).any()


def test_what_is_learned_from_is_bounded_by_rows_and_bytes(spark):
    docs = spark.createDataFrame([(1, "same " + "x" * 50)] * 300 + [(k, f"idiot {prose(k, 20)}") for k in range(2, 30)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 30)], "doc_id long, toxic int")
    seen = []
    fit, toxicity.fit = toxicity.fit, lambda texts, toxic, window: seen.append(texts) or fit(texts, toxic, window)
    try:
        toxicity.train(docs, labels, max_bytes=400)
    finally:
        toxicity.fit = fit
    assert 0 < len(seen[0]) < 12 and len(set(seen[0])) == len(seen[0])
    got = []
    fit, langid.fit = langid.fit, lambda texts, langs, penalty: got.append(texts) or fit(texts, langs, penalty)
    try:
        langid.train(docs, max_bytes=400)
    finally:
        langid.fit = fit
    assert 0 < len(got[0]) < 12 and len(set(got[0])) == len(got[0])


def test_toxicity_of_awkward_rows(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 1), (6, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    model = toxicity.train(odd, labels)
    got = toxicity.score(odd, model).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.score(none, toxicity.train(none, labels.limit(0))).count() == 0


# -- mixing -------------------------------------------------------------------


def size(text):
    import re

    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def water_fill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: w[s] * rest / sum(w[t] for t in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] * (1 + 1e-12)}
        if not over:
            return target | share
        for s in over:
            target[s] = float(cap * sizes[s])
            rest -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(k, prose(k, rng.randrange(0, 120)), rng.choice(["a", "a", "a", "b", "c", None, "é"])) for k in range(900)]
    rows.append((900, None, "b"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.mix_sources(df, bucket_docs=50).collect()
    again = mixing.mix_sources(df.repartition(3), bucket_docs=50).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again) and len(got) == 901
    total = collections.Counter()
    for i, t, s in rows:
        total[s] += size(t)
    target = water_fill(total)
    taken = collections.Counter()
    for r in got:
        assert r.size == size(rows[r.doc_id][1]) and 0 <= r.taken <= 3 * r.size and r.source_size == total[r.source]
        assert r.target == pytest.approx(target[r.source])
        taken[r.source] += r.taken
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(0.02 * t, 100)


def test_sources_of_few_blocks_meet_their_targets(spark):
    """Sources of a part of a block up to five, and a large one, against the targets alone."""
    sizes = {"a": 500 * 2000 // 10, **{f"s{k}": n for k, n in enumerate([1, 340, 510, 600, 1023, 1025, 2500, 5000])}}
    rows = []
    for name, n in sizes.items():
        step = 200 if name == "a" else 170
        rows += [(len(rows) + i, " ".join(["w"] * min(step, n - at)), name) for i, at in enumerate(range(0, n, step))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = water_fill(sizes)
    for block in (None, 333, 1024):
        taken = collections.Counter()
        for r in mixing.mix_sources(df, block=block).collect():
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] += r.taken
        assert all(abs(taken[s] - t) <= 1 for s, t in target.items())
    # the slots: each takes words of one block, the ranks of a source in the order of the schedule
    sources = mixing.cut_blocks(mixing.targets(df.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("source_size"), F.count(F.lit(1)).alias("n_docs"))), 333, 3)
    n = sources.agg(F.sum("slots")).first()[0]
    slots = mixing.slots_of(spark, sources, n).join(sources.select("k", "source"), "k").collect()
    words_ = collections.Counter()
    for r in slots:
        assert 0 <= r.first < r.upto
        words_[r.source] += r.upto - r.first
    assert len(slots) == n and words_ == {s: round(t) for s, t in target.items()}
    place = sorted((r.slot, r.source) for r in slots)
    big = [i for i, (_, s) in enumerate(place) if s == "a"]
    gaps = np.diff(big)
    assert gaps.max() <= 12  # spread over the mix, not in a run


def test_mix_of_awkward_rows(odd, none):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 12 and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix_sources(none).count() == 0
    assert {r.taken for r in mixing.mix_sources(odd.where("text is null")).collect()} == {0}


def test_small_sources_meet_their_targets_in_the_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    many = " ".join(["w"] * 20_000)
    rows = [(k, many, "en", "large", 0) for k in range(60)] + [(60 + k, prose(k, n), "en", f"s{k}", 0) for k, n in enumerate([7, 100, 300, 600, 1100])] + [(70, None, "en", "s0", 0), (71, prose(9, 4), "en", "s0", 0)]
    got = cp.mix(spark, spark.createDataFrame(rows, SCHEMA), sf_dir).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(got) == len(rows) and all(taken[s] == round(t) for s, t in target.items()) and len(target) == 6


# -- lines --------------------------------------------------------------------


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_line_dedup_agrees_with_brute_force(spark, most):
    rng = random.Random(4)
    shared = [prose(k, 4) for k in range(5)]
    rows = []
    for k in range(200):
        lines = [rng.choice(shared) + rng.choice(["", " "]) if rng.random() < 0.15 else prose(k * 10 + j, 6) for j in range(5)] + ["", "  "]
        rows.append((k, "\n".join(lines), rng.choice(["x", "y", None])))
    rows += [(200, None, "x"), (201, "", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("N_lines", F.lit("clash"))
    pages, holds = collections.Counter(s for *_, s in rows), collections.Counter()
    for _, t, s in rows:
        holds.update({(s, x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in holds.items() if n >= 3 and n > 0.05 * pages[k[0]]}
    assert bad
    got = {r.doc_id: r for r in linededup.drop_boilerplate(df, ratio=0.05, broadcast_lines=most, salts=3).collect()}
    for i, t, s in rows:
        kept = None if t is None else "\n".join(x for x in t.split("\n") if (s, x.strip(" ")) not in bad)
        assert got[i].text == kept and got[i].n_lines == (0 if t is None else t.count("\n") + 1)
        assert got[i].n_dropped == (0 if t is None else sum((s, x.strip(" ")) in bad for x in t.split("\n")))


def test_line_dedup_is_native_and_takes_awkward_rows(odd, none):
    got = linededup.drop_boilerplate(odd)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and got.count() == 12
    assert linededup.drop_boilerplate(none).count() == 0


def test_copies_of_a_page_are_not_boilerplate_in_the_pipeline(spark, sf_dir):
    import corpus_pipeline as cp

    copy = "\n".join(prose(700 + j, 8) for j in range(3))
    rows = [(k, copy + " \n" * (k % 2), "en", "x", len(copy)) for k in range(40)]
    rows += [(k, "site menu\n" + prose(k, 30), "en", "x", 0) for k in range(40, 120)] + [(120 + k, copy, "en", "y", 0) for k in range(3)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = cp.drop_boilerplate_lines(spark, docs, sf_dir).collect()
    assert len(got) == 123
    for r in got:
        text = rows[r.doc_id][1]
        assert r.text == (text[len("site menu\n"):] if text.startswith("site menu") else text)


# -- tokens -------------------------------------------------------------------


def test_token_counts_agree_with_the_library(spark, sf_dir, odd, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(6)
    texts = ["", "<|endoftext|> it's<|startoftext|>x", "ΣΑΣ ὈΔΥΣΣΕΎΣ", "İstanbul ǅ", "é é Å", "日本語 123４５", "a\x00d\x1f", "x" * 5000, "ﬁ ß ẞ ÀÉ×÷", "''''s's 'S", "½ ² Ⅷ", "नमस्ते", "\x85x​q\xa0z"]
    texts += ["".join(rng.choice("abZé ÉÀß×÷'s12 \n\t!?.,<|éàÎ") for _ in range(rng.randrange(1, 30))) for _ in range(500)]
    texts += [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in tokencount.token_counts(df, VOCABULARY).collect():
        n = len(library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((texts[r.doc_id] or "").encode()), n > 2048), texts[r.doc_id][:60]
    got = tokencount.token_counts(odd, VOCABULARY).collect()
    assert len(got) == 12 and all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in got)
    assert tokencount.token_counts(none, VOCABULARY).count() == 0


# -- queries and pipeline -----------------------------------------------------


def test_contamination_digest(spark, sf_dir):
    from tidemark.llm.queries import op2_decontaminate

    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op2_decontaminate(spark, sf_dir).collect():
        n, hit, items = brute_hits(docs[r.doc_id], bench)
        assert (r.n_words, r.n_hit, r.n_items) == (n, hit, len(items)) and r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest() and r.contaminated == (hit > 0)
    assert lower("AbÉ") == "abÉ"


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline as cp

    rows = awkward(spark, extra=False)
    rows.withColumn("score", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the benchmark says one thing"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    texts = collections.Counter((r.text or "")[:7] for r in got)
    assert texts == collections.Counter({"": 1, "one two": 1, prose(1, 30_000)[:7]: 1, "日本語 Ünï": 1}) and all(0 <= r.taken <= 3 * r.size for r in got)
    # empty tables
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0


def test_pipeline_agrees_with_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(model.features([r.text or ""])[0])[0] < 0.5]
    pages, holds = collections.Counter(r.source for r in rows), collections.Counter()
    for r in rows:
        holds.update({(r.source, x.strip(" ")) for x in (r.text or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in holds.items() if n >= 3 and n > 0.02 * pages[k[0]]}
    text = {r.doc_id: None if r.text is None else "\n".join(x for x in r.text.split("\n") if (r.source, x.strip(" ")) not in bad) for r in rows}
    rows.sort(key=lambda r: r.doc_id)
    label = brute_classes([(r.doc_id, text[r.doc_id]) for r in rows])
    rows = [r for k, r in enumerate(rows) if label[k] == k]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {r.doc_id: text[r.doc_id] for r in rows if not brute_hits(text[r.doc_id], bench)[1]}
    got = cp.run(spark, sf_dir).collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.size == size(r.text) and r.taken <= 3 * r.size for r in got)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near-duplicates", "decontamination", "source mixing"]
    assert all(r.n_chars == len(r.text) for r in got if r.text is not None)
