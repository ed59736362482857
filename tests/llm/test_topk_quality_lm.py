import binascii
import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barograph.llm import lm, quality, topk


def brute(ids, vecs, queries, k):
    dim = max(map(len, vecs.values()), default=0)
    full = {i: np.pad(np.array(v, dtype=object), (0, dim - len(v))) for i, v in vecs.items()}
    out = []
    for q in queries:
        ranked = sorted((-int(full[i] @ full[q]) if dim else 0, i) for i in ids if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    return sorted(out)


def check_topk(spark, vecs, queries, k=5, **how):
    df = spark.createDataFrame([(i, [int(x) for x in v]) for i, v in vecs.items()], "id long, v array<long>")
    got = topk.topk(df, df.filter(F.col("id").isin(list(queries))), k, **how)
    assert sorted(tuple(r) for r in got.collect()) == brute(list(vecs), vecs, queries, k)


def test_topk_is_exact(spark):
    rng = np.random.default_rng(7)
    clustered = {i: (rng.normal(0, 100, 12) if i % 3 else np.full(12, 50)).astype(int) for i in range(900)}
    check_topk(spark, clustered, range(0, 900, 30), n_pivots=5, annuli=4)
    check_topk(spark, {i: rng.integers(-3, 4, 3) for i in range(300)}, range(0, 300, 7), k=3)  # many ties
    check_topk(spark, {1: [1, 2], 2: [3], 3: [], 4: [5, -5, 5]}, [1, 3, 4])
    check_topk(spark, {1: [7]}, [1])
    check_topk(spark, {i: [0, 0] for i in range(20)}, [0, 5])
    big = {i: rng.integers(-(2**28), 2**28, 6) for i in range(200)}
    check_topk(spark, big, range(0, 200, 9))
    empty = spark.createDataFrame([], "id long, v array<long>")
    assert topk.topk(empty, empty).count() == 0


def test_topk_of_repeated_and_odd_rows(spark):
    rows = [(2, [9]), (2, [3]), (None, [50]), (4, None), (5, [1]), (5, [1]), (6, [2, 0]), (6, [2]), *[(7, [8])] * 9]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, v array<long>, tag string, query int")
    got = topk.topk(df, df, k=4)
    kept = [(i, v) for i, v in rows if i is not None and v is not None]
    want = []
    for q in {(i, tuple(v)) for i, v in kept}:
        others = list(kept)
        others.remove((q[0], list(q[1])))
        ranked = sorted((-v[0] * q[1][0], i) for i, v in others)[:4]
        want += [(q[0], n + 1, i, -s) for n, (s, i) in enumerate(ranked)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert topk.topk(df, df.filter("id > 99")).count() == 0


def test_annuli_far_from_a_query_are_passed_over():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 200, (24, 16))
    x = centres[rng.integers(0, 24, 4000)] + rng.normal(0, 6, (4000, 16))
    longest = np.sqrt((x * x).sum(1).max())
    lift = lambda x: np.hstack([x, np.sqrt(np.maximum(0, longest**2 - (x * x).sum(1)))[:, None]])
    pivots = lift(centres * np.minimum(1, longest / np.sqrt((centres**2).sum(1)))[:, None])
    d = np.sqrt(((lift(x)[:, None, :] - pivots) ** 2).sum(2))
    cell = d.argmin(1)
    used, at, n = np.unique(cell, return_inverse=True, return_counts=True)
    ends = [np.array([f(d[at == c], axis=0) for c in range(len(used))]) for f in (np.min, np.max)]
    norm = np.array([np.sqrt((x[at == c] ** 2).sum(1)).max() for c in range(len(used))])
    known = topk.Annuli(pivots, longest, *ends, norm, used, n)
    q = x[::50]
    bound, _ = known.bounds(q)
    real = np.sqrt(((lift(x) - np.hstack([q, np.zeros((len(q), 1))])[:, None, :]) ** 2).sum(2))
    assert (bound[:, at] <= real).all()
    reach = np.sort(real, axis=1)[:, 5]
    assert ((bound <= reach[:, None]) @ n).sum() < 0.25 * real.size


def test_integral_vectors(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [1.0, None]), (4, [float("nan")]), (5, [float("inf")]), (6, [])]
    got = topk.integral(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert {r["id"]: r["v"] for r in got} == {1: [128, -1], 6: []}


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5) | (x[:, 2] > 1.2)).astype(float)
    rules = quality.fit(x, y, list("abcd"))
    assert 0 < len(rules.rules) < 200
    margin = quality.matches(x, rules.rules) @ np.array(rules.weights) + rules.bias
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")).assign(i=range(3000)))
    got = np.array([r["s"] for r in df.select("i", rules.score().alias("s")).orderBy("i").collect()])
    np.testing.assert_allclose(got, 1 / (1 + np.exp(-margin)), rtol=1e-5)
    assert ((got > 0.5) == y).mean() > 0.97
    for few in (quality.fit(x[:5], y[:5], list("abcd")), quality.fit(x, np.ones(3000), list("abcd")), quality.fit(x[:0], y[:0], list("abcd"))):
        assert few.rules == [] and math.isfinite(few.bias)


def test_quality_on_held_out_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels)
    assert out.count() == docs.count()
    rows = out.filter("held_out").join(labels, "doc_id").collect()
    y, p = np.array([r["quality"] for r in rows]), np.array([r["predicted"] for r in rows])
    assert all(binascii.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows)
    assert (p[y == 1] == 1).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.9


def test_quality_of_odd_tables(spark, odd_docs):
    labels = spark.createDataFrame([(0, 1), (0, 0), (3, None), (None, 1), (5, 0)], "doc_id long, quality int")
    rows = quality.report(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    assert quality.report(odd_docs, labels.limit(0)).count() == len(rows)
    assert quality.report(odd_docs.limit(0), labels).count() == 0
    assert quality.keep_good(odd_docs, labels).columns == odd_docs.columns


def plain_base(rows):
    held = lambda i: i is not None and binascii.crc32(str(i).encode()) % 5 == 1
    train = [lm.words_of(t) for i, t in rows if not held(i)]
    c = Counter(w for ws in train for w in ws)
    if train:
        c[None] = len(train)
    n, v = sum(c.values()), len(c)
    p = lambda w: math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1)))
    return [(i, held(i), len(lm.words_of(t)) + 1, sum(c[w] > 0 for w in [*lm.words_of(t), None]), n, sum(p(w) for w in [*lm.words_of(t), None])) for i, t in rows]


def test_language_model(spark, sf_dir, odd_docs):
    for docs in (spark.read.parquet(f"{sf_dir}/documents.parquet"), odd_docs):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        got = sorted(lm.score(docs).collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
        want = sorted(plain_base(rows), key=lambda r: (str(r[0]), r[2]))
        for g, w in zip(got, want, strict=True):
            assert tuple(g)[:5] == w[:5] and math.isclose(g["base_score"], w[5], rel_tol=1e-9) and g["score"] < 0
        if len(rows) > 100:
            held = [g for g in got if g["held_out"]]
            assert sum(g["score"] for g in held) > sum(g["base_score"] for g in held)
    assert lm.score(odd_docs.limit(0)).count() == 0
    assert [tuple(r)[:6] for r in lm.score(spark.createDataFrame([(6, "a b")], "doc_id long, text string")).collect()] in ([(6, False, 3, 3, 3, plain_base([(6, "a b")])[0][5])], [(6, True, 3, 0, 0, 0.0)])


def test_model_probabilities_add_up():
    """Over all symbol strings of a length, forward probabilities sum to one; Baum-Welch raises likelihood."""
    rng = np.random.default_rng(9)
    shares = np.full(4, 0.25)
    texts = [rng.integers(0, 2, n).astype("<u2") + 2 * (n % 2) for n in rng.integers(2, 12, 80)]
    texts = [np.minimum(t, 3).astype("<u2") for t in texts]
    model = lm.starting_model([], shares, states=3)
    every = [np.array([a, b, c], "<u2") for a in range(4) for b in range(4) for c in range(4)]
    assert math.isclose((10 ** model.log10(every)).sum(), 1, rel_tol=1e-9)
    before = model.log10(texts).sum()
    for _ in range(10):
        first, moves, emits = model.expected(texts)
        assert math.isclose(first.sum(), len(texts), rel_tol=1e-9) and math.isclose(emits.sum(), sum(map(len, texts)), rel_tol=1e-9)
        assert math.isclose(moves.sum(), sum(len(t) - 1 for t in texts), rel_tol=1e-9)
        model = lm.Model(first / first.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(0))
        after = model.log10(texts).sum()
        assert after >= before - 1e-9
        before = after
    # the scaled recursion against plain sums over state paths
    t = texts[0][:4]
    a = model.start * model.emit[t[0]]
    for s in t[1:]:
        a = (a @ model.move) * model.emit[s]
    assert math.isclose(model.log10([t])[0], math.log10(a.sum()), rel_tol=1e-9)
