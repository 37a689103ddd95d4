"""Ranked search, whitening and bottom-k sketches against brute force, and their edge cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.llm import lexical_search, sketch_dedup, whitening, words

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts(r, n, vocabulary, most=60):
    return [" ".join(r.choice(vocabulary) for _ in range(r.randint(0, most))) for _ in range(n)]


# Ranked search


def best(docs, items, most):
    """Rows (item_id, rank, doc_id, score) by the definition."""
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in terms), sum(len(t) for _, t in terms)
    df = Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        asked, scored = Counter(TERM.findall((text or "").translate(LOWER))), []
        for i, t in terms:
            tf, score = Counter(t), 0
            for x, times in asked.items():
                if tf[x]:
                    m = 75 + 25 * len(t) * n_docs // total
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf[x] // (1000 * tf[x] + 12 * m))
            if score > 0:
                scored.append((-score, i is None, i))
        scored.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(scored[:most])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def library():
    r = random.Random(11)
    vocabulary = [f"w{int(r.paretovariate(0.6)) % 300}" for _ in range(2000)] + ["Été", "été", "日本", "A1", "a1"]
    docs = list(enumerate(texts(r, 400, vocabulary)))
    docs += [(400, None), (401, ""), (402, "-- !!"), (403, docs[3][1]), (404, docs[3][1]), (5, "w1 w2 same id"), (None, "w1 w2 no id"), (None, docs[3][1]), (405, "w7 " * 20_000 + "w8")]
    items = [(k, t) for k, t in enumerate(texts(r, 30, vocabulary, 12))] + [(90, None), (91, "..."), (92, "unheard of"), (3, "w1"), (None, "w2 W2 w3"), (93, docs[3][1])]
    return docs, items


def test_ranked_search(spark, library):
    docs, items = library
    d = spark.createDataFrame([(t, i, "x", 1) for i, t in docs], "text string, doc_id long, item_id string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, doc_id long")
    for group in (8 << 20, 300):  # in one group of queries and in many
        got = lexical_search.lexical_search(d, q, 7, group).select("item_id", "rank", "doc_id", "score").collect()
        assert sorted(map(tuple, got), key=repr) == best(docs, items, 7)
    assert lexical_search.lexical_search(d.limit(0), q).count() == 0
    assert lexical_search.lexical_search(d, q.limit(0)).count() == 0


def test_blocks_are_pruned(library):
    r = random.Random(3)
    queries = lexical_search.Queries([b"rare1 common", b"common", b""])
    number = {t: i for i, t in enumerate(queries.terms.tolist())}
    term = lambda w: number[words.hashed_runs([w], words.ALNUM)[0][0]]

    def block(first, rare):
        rows = [sorted([(term(b"common"), r.randint(1, 3))] + ([(term(b"rare1"), 2)] if k < rare else [])) for k in range(10)]
        parts = [np.arange(first, first + 10), np.full(10, 20), np.cumsum([0] + [len(x) for x in rows]).astype(np.int32)]
        parts += [np.array([v[k] for x in rows for v in x], np.int32) for k in (0, 1)]
        return lexical_search.Block(*[p.tobytes() for p in parts], 1000, 20_000)

    blocks = [block(10 * k, 10 if k == 7 else 0) for k in range(20)]
    weights = np.zeros(2, np.int64)
    weights[term(b"common")], weights[term(b"rare1")] = 10, 5000
    search = lexical_search.Search(queries, weights, np.zeros(3, np.int64), 5)
    search.run(blocks, False)
    assert set(search.best[0][1] // 10) == {7} and len(search.best[2][0]) == 0
    assert search.scored < 1 + 20 + 1  # the first query is done after its best block


# Whitening


def whitened(rows):
    """(n, {vec_id: (deviation, whitened)}, explained) by exact integers."""
    usable = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in usable})
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(dims)]
    centred = np.array([[n * x[j] - sums[j] for j in range(dims)] for x in fit], object)
    cov = np.array([[int(c) / n**3 for c in row] for row in centred.T @ centred])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    each = [(i, sum((n * c - s) ** 2 for c, s in zip(x, sums)), (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors) / np.sqrt(np.maximum(values, 1e-300))) for i, x in usable]
    return n, each, values / cov.trace()


def vectors(r, n, dims):
    mix = r.normal(size=(dims, dims))
    return [(k, (r.normal(size=dims) @ mix).astype(np.float32).tolist()) for k in range(n)]


def test_whitening(spark):
    r = np.random.default_rng(4)
    rows = vectors(r, 300, 20)
    rows += [(500, rows[0][1]), (500, rows[0][1]), (None, rows[1][1]), (501, None), (502, [None] * 20), (503, [float("nan")] * 20), (504, [float("inf")] + [0.0] * 19), (505, [1.0]), (506, []), (507, [-3.5e4] + [0.5] * 19)]
    frame = spark.createDataFrame([(v, i, 1.0, 2) for i, v in rows], "embedding array<float>, vec_id long, whitened double, n int").repartition(3)
    got = whitening.whiten(frame).collect()
    n, each, explained = whitened([(i, v) for i, v in rows if v is None or len(v) == 20])
    assert {g.n for g in got} == {n} and len(got) == 16 * len(each) and max(g.identity_error for g in got) < 1e-8
    by_id = {}
    for g in got:
        by_id.setdefault(g.vec_id, []).append(g)
    signs = np.sign([by_id[0][k].whitened for k in np.argsort([g.component for g in by_id[0]])]) * np.sign(each[0][2][:16])
    for i, deviation, z in each:
        mine = sorted((g.component, g.deviation, g.whitened, g.explained) for g in by_id[i])
        assert {m[1] for m in mine} == {deviation} and [m[0] for m in mine[:: len(mine) // 16]] == list(range(1, 17))
        assert np.allclose([m[2] for m in mine[:: len(mine) // 16]], z[:16] * signs, rtol=1e-6, atol=1e-7)
        assert np.allclose([m[3] for m in mine[:: len(mine) // 16]], explained[:16], rtol=1e-9)
    assert whitening.whiten(frame.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")).count() == 0
    few = whitening.whiten(spark.createDataFrame([(1, [0.5, 2.0, 1.0]), (2, [1.5, 0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert [(g.component, abs(round(g.whitened, 9))) for g in few] == [(1, 1.0)] * 2 and few[0].explained == pytest.approx(1)


def test_exact_scatter():
    r = np.random.default_rng(1)
    for high in (300, 2**31, 2**52):
        x = r.integers(-high, high, (3000, 5))
        want = x.T.astype(object) @ x.astype(object)
        moduli = whitening.primes(2 * 3000 * high**2)
        assert len(set(moduli)) == len(moduli) and all(2**20 < p < 2**21 for p in moduli)
        assert (whitening.combined([whitening.modular_scatter(x, p) for p in moduli], moduli) == want).all()
    # the largest residues in a full block stay exact
    p = moduli[0]
    edge = np.full((2 * whitening.ROWS_AT_ONCE, 2), p // 2)
    assert whitening.modular_scatter(edge, p)[0, 0] == len(edge) * (p // 2) ** 2 % p


def test_deviation_beyond_64_bits(spark):
    rows = [(k, [2.0**40 * (k % 7), float(k)]) for k in range(30)]
    got = {g.vec_id: g.deviation for g in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    _, each, _ = whitened(rows)
    assert got == {i: d if d < 2**63 else None for i, d, _ in each} and None in got.values()


# Bottom-k sketches


def classes(rows, n=3, percent=85):
    """(doc_id, n_shingles, component) of every row by comparing all pairs; rows go in order of their numbers."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    ids = [[rows[j][0] for j in range(len(rows)) if root(j) == root(i)] for i in range(len(rows))]
    out = [(rows[i][0], len(sets[i]), min((x for x in ids[i] if x is not None), default=None)) for i in range(len(rows))]
    return sorted(((i, n, c, i == c) for i, n, c in out), key=repr)


def changed(r, text, share):
    w = text.split()
    for k in range(len(w)):
        if r.random() < share:
            w[k] = f"x{r.randint(0, 10**6)}"
    return " ".join(w)


def test_sketch_classes(spark, monkeypatch):
    r = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    plain = [" ".join(r.choice(vocabulary) for _ in range(r.randint(30, 160))) for _ in range(60)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = [changed(r, t, s) for t in plain[:25] for s in (0, 0.01, 0.02, 0.03, 0.06)]
    rows += [changed(r, plain[30], 0.02) for _ in range(60)]  # a group of copies longer than a block
    rows += [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(2, 90))) for _ in range(90)]
    rows += [plain[40], plain[40].upper(), plain[40].replace(" ", "\t\n "), "one two", "One  TWO", "one", "", "   ", None, "a b c", "a b c a b c", "é É", "x" * 700_000, " ".join(vocabulary * 40)]
    docs = list(enumerate(rows)) + [(None, plain[41]), (None, "nobody like this at all"), (7, plain[41]), (7, "same id other text")]
    r.shuffle(docs)
    want = classes(sorted(docs, key=lambda x: (x[0] is None, x[0] or 0)))
    frame = spark.createDataFrame([(t, i, 5) for i, t in docs], "text string, doc_id long, component_id int").repartition(3)
    assert sorted((tuple(g) for g in sketch_dedup.sketch_dedup(frame).drop("row_number").collect()), key=repr) == want
    # with common values, long lists and a second look at what the largest component of a list lacks
    monkeypatch.setattr(sketch_dedup, "COMMON", 12)
    monkeypatch.setattr(sketch_dedup, "BLOCK", 8)
    assert sorted((tuple(g) for g in sketch_dedup.sketch_dedup(frame).drop("row_number").collect()), key=repr) == want
    assert sketch_dedup.sketch_dedup(frame.limit(0)).count() == 0


def test_union_sketch():
    r = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, int(r.integers(1, 200)))) for _ in range(2))
        both = np.union1d(a, b)[: sketch_dedup.KEPT]
        want = len(np.intersect1d(np.intersect1d(a, b), both)), len(both)
        assert sketch_dedup.union_overlap(a[: sketch_dedup.KEPT], b[: sketch_dedup.KEPT]) == want


def test_links_at_the_threshold_survive_their_sketches():
    r = np.random.default_rng(6)
    least = sketch_dedup.fewest(85)
    for _ in range(2000):
        shared, own = 850, 75
        x = r.integers(0, 2**63, shared + 2 * own)
        a, b = np.sort(np.concatenate((x[:shared], x[shared : shared + own]))), np.sort(np.concatenate((x[:shared], x[shared + own :])))
        both, k = sketch_dedup.union_overlap(a[: sketch_dedup.KEPT], b[: sketch_dedup.KEPT])
        assert both >= least[k] and len(np.intersect1d(a[: sketch_dedup.LISTED], b[: sketch_dedup.LISTED]))


def test_long_texts_are_hashed_in_parts():
    text = ("Wörd two,three\n" * 5000 + "y" * 3000 + " end").encode()
    for inside in (words.ALNUM, words.BLACK):
        whole, bounds = words.hashed_runs([b"", text, b"two"], inside)
        parts, cuts = words.hashed_runs([b"", text, b"two"], inside, 1000)
        assert np.array_equal(whole, parts) and np.array_equal(bounds, cuts) and bounds[1] == 0


def test_thinned_keeps_what_is_asked_for(spark):
    rows = spark.range(5000).select(F.col("id").alias("node"), F.lit("t").alias("text"))
    asked = rows.where("node % 50 = 3").select("node")
    got = {r.node for r in sketch_dedup.thinned(rows, asked).collect()}
    assert {r.node for r in asked.collect()} <= got and len(got) < 110
    assert sketch_dedup.thinned(rows, asked.limit(0)).count() == 0


def test_second_look_copies_sets_once_a_wide_unit(spark, monkeypatch):
    """Texts that share a passage and are not connected meet in wide units, and no link between them is lost."""
    r = random.Random(5)
    vocabulary = [f"v{k}" for k in range(3000)]
    passage = " ".join(r.choice(vocabulary) for _ in range(60))
    rows = [passage + " " + " ".join(r.choice(vocabulary) for _ in range(r.randint(20, 30))) for _ in range(96)]
    rows += [t + " and more" for t in rows[:6]]
    monkeypatch.setattr(sketch_dedup, "COMMON", 12)
    monkeypatch.setattr(sketch_dedup, "BLOCK", 8)
    monkeypatch.setattr(sketch_dedup, "WIDE", 64)
    made, in_units = [], sketch_dedup.in_units
    monkeypatch.setattr(sketch_dedup, "in_units", lambda places, *a: made.append(places.count()) or in_units(places, *a))
    docs = list(enumerate(rows))
    got = sketch_dedup.sketch_dedup(spark.createDataFrame(docs, "doc_id long, text string")).drop("row_number").collect()
    assert sorted((tuple(g) for g in got), key=repr) == classes(docs)
    # a set is on 12 lists at most, each under two grades of size, and in two groups or two blocks there
    assert len(made) == 2 and made[1] <= len(rows) * 12 * 2 * (2 + 2)


def test_pairs_of_two_sides():
    r = np.random.default_rng(3)
    base = r.integers(0, 2**32, 200, np.uint32)
    sketches = [np.unique(np.where(r.random(200) < 0.1, r.integers(0, 2**32, 200, np.uint32), base))[: sketch_dedup.KEPT] for _ in range(40)]
    size, sides, least = np.full(40, 200), r.integers(0, 2, 40), sketch_dedup.fewest(85)
    _, _, whole = sketch_dedup.open_pairs(sketches, size, 85, least, None)
    rows, columns, open_ = sketch_dedup.open_pairs(sketches, size, 85, least, sides)
    assert open_.shape == ((sides == 0).sum(), (sides == 1).sum()) and open_.any()
    assert np.array_equal(open_, (whole | whole.T)[np.ix_(rows, columns)])


def test_intersections_of_values_that_few_or_many_pairs_share():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**62, 80)
    some = lambda n: [np.unique(np.concatenate((r.choice(base, int(r.integers(0, 70)), replace=False), r.integers(0, 500, 20)))) for _ in range(n)]
    a, b = some(70), [*some(45), np.zeros(0, np.int64)]
    assert sketch_dedup.intersections(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]
    assert not sketch_dedup.intersections(a[:1], b[-1:]).any()


def test_pairs_of_a_set_are_estimated_in_batches(monkeypatch):
    """Sets that overlap a lot and are no duplicates: their pairs were estimated one by one, each time with a search of its own."""
    r = np.random.default_rng(8)
    base = r.integers(0, 2**32, 30)
    sketches = [np.concatenate((base, r.integers(0, 2**32, 18))) for _ in range(64)] + [base[:20]]
    sketches[40] = np.append(sketches[7][:-1], 5)
    size = np.array([len(s) for s in sketches])
    asked, several = [], sketch_dedup.union_overlaps
    monkeypatch.setattr(sketch_dedup, "union_overlaps", lambda a, others, kept: asked.append(len(others)) or several(a, others, kept))
    monkeypatch.setattr(sketch_dedup, "fewest", lambda percent: np.where(np.arange(sketch_dedup.KEPT + 1) < 48, 0, 46))
    monkeypatch.setattr(sketch_dedup, "open_pairs", lambda s, *_: (np.arange(len(s)), np.arange(len(s)), np.triu(np.ones((len(s), len(s)), bool), 1)))
    size[-1] = 20
    assert [7, 40] in sketch_dedup.estimated(sketches[:-1], size[:-1], np.arange(64), 85, None)
    assert sum(asked) > 1500 and len(asked) < sum(asked) / 5
    # known components are not asked for again
    asked.clear()
    assert sketch_dedup.estimated(sketches[:-1], size[:-1], np.zeros(64, int), 85, None) == [] and not asked
