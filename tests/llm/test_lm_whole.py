import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from barograph.llm import lm


def test_what_follows_word_400_shapes_the_model_and_layout_does_not(spark):
    """Every text has 400 equal words and then an order that only a model of the whole texts can learn."""
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(40):
        kind = np.repeat(rng.integers(0, 2, 20), 10)  # stretches of ten words of one kind
        texts.append(np.concatenate([np.zeros(400, int), 1 + 4 * kind + rng.integers(0, 4, 200)]).astype("<u2"))
    shares = (np.bincount(np.concatenate(texts), minlength=10) + 0.5) / sum(map(len, texts))
    shares /= shares.sum()
    rows = spark.createDataFrame([(bytearray(t.tobytes()),) for t in texts], "symbols binary")
    scores = []
    for parts in (1, 5):
        scores.append(lm.train(rows.repartition(parts), shares, states=3).log10(texts))
    np.testing.assert_allclose(scores[0], scores[1], rtol=1e-6)
    assert scores[0].sum() / (40 * 200) > -0.78  # the later words' own shares give log10(1/8) = -0.90


def test_stretches_of_long_texts_count_as_whole_ones_do():
    rng = np.random.default_rng(4)
    texts = [np.repeat(rng.integers(0, 3, n // 20 + 1), 20)[:n].astype("<u2") * 3 + rng.integers(0, 3, n).astype("<u2") for n in (1, 2, 700, 1024, 1025, 1100, 5000, 12_000)]
    shares = np.bincount(np.concatenate(texts), minlength=10) + 0.5
    shares /= shares.sum()
    model = lm.starting_model([], shares, states=3)
    for _ in range(4):
        want = [np.zeros(3), np.zeros((3, 3)), np.zeros((10, 3))]
        for t in texts:  # plain recursions over the whole text
            e, alpha, beta = model.emit[t], np.zeros((len(t), 3)), np.ones((len(t), 3))
            for i in range(len(t)):
                alpha[i] = (alpha[i - 1] @ model.move if i else model.start) * e[i]
                alpha[i] /= alpha[i].sum()
            for i in range(len(t) - 2, -1, -1):
                beta[i] = model.move @ (e[i + 1] * beta[i + 1])
                beta[i] /= beta[i].sum()
            gamma = alpha * beta
            gamma /= gamma.sum(1, keepdims=True)
            want[0] += gamma[0]
            np.add.at(want[2], t, gamma)
            for i in range(len(t) - 1):
                xi = alpha[i][:, None] * model.move * (e[i + 1] * beta[i + 1])
                want[1] += xi / xi.sum()
        for kind, most in ((np.float32, 400_000), (np.float64, 1500)):
            for x, y in zip(model.expected(texts, shares, kind, most), want, strict=True):
                np.testing.assert_allclose(x, y, rtol=2e-3, atol=2e-3 * y.max())
        model = model.updated(*want, shares)


def test_places_among_equal_counts_are_all_filled(spark):
    rows = [(f"w{i}".encode(), 7) for i in range(30_000)] + [(f"v{i}".encode(), 7 + i) for i in range(1, 40)] + [(b"rare", 1), (b"top", 10**7), (b"top2", 10**7 + 1)]
    counts = spark.createDataFrame(rows, "word binary, c long")
    got = lm.frequent(counts, 20_000)
    assert got.num_rows == 20_000 and got["word"].to_pylist()[:3] == [b"top2", b"top", b"v39"] and set(got["c"].to_pylist()) == {7, *range(8, 47), 10**7, 10**7 + 1}
    assert got.equals(lm.frequent(counts.repartition(7), 20_000))
    assert lm.frequent(counts, 40_000).num_rows == len(rows) and lm.frequent(counts.limit(0)).num_rows == 0 and lm.frequent(counts, 2)["word"].to_pylist() == [b"top2", b"top"]


def test_scores_by_brute_force(spark, docs_of, odd_docs, monkeypatch):
    """Every column by definition, with words of every kind: symbols, known words and joined ones."""
    monkeypatch.setattr(lm, "WORDS", 12)
    models = []
    trained = lm.train
    monkeypatch.setattr(lm, "train", lambda *a: models.append(trained(*a)) or models[-1])
    rng = np.random.default_rng(6)
    vocabulary = [f"w{int(x)}" for x in 1 / rng.random(400)]
    table = docs_of([(i, " ".join(rng.choice(vocabulary, rng.integers(0, 60)))) for i in range(120)] + [(7, "Twice  \n w1"), (7, "Twice  \n w1"), (None, "no id w1"), (1, None)])
    for docs in (table, odd_docs):
        got = lm.score(docs, states=3, rounds=3, most_known=30).collect()
        rows = [(r["doc_id"], lm.words_of(r["text"])) for r in docs.select("doc_id", "text").collect()]
        held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
        c = Counter(w for i, ws in rows if not held(i) for w in ws)
        counts = spark.createDataFrame([(w, n) for w, n in c.items()], "word binary, c long")
        symbols = {w: k + 1 for k, w in enumerate(lm.frequent(counts, 30)["word"].to_pylist()[:12])}
        ends = sum(not held(i) for i, _ in rows)
        total, kinds = sum(c.values()) + ends, len(c) + 1
        mass = np.full(lm.CLASSES, 0.5)
        for w, n in c.items():
            if w not in symbols:
                mass[lm.class_of(w)] += n + 0.5
        model, want = models[-1], []
        for i, ws in rows:
            now, score = None, 0.0
            for w in [*ws, None]:
                s = 0 if w is None else symbols.get(w, len(symbols) + 1 + lm.class_of(w))
                now = (model.start if now is None else now @ model.move) * model.emit[s]
                score += math.log10(now.sum()) + (math.log10((c[w] + 0.5) / mass[lm.class_of(w)]) if s > len(symbols) else 0)
                now = now / now.sum()
            base = sum(math.log10(((ends if w is None else c[w]) + 0.5) / (total + 0.5 * (kinds + 1))) for w in [*ws, None])
            want.append((str(i), held(i), len(ws) + 1, sum(c[w] > 0 for w in ws) + 1, total, base, score))
        got = sorted((str(r["doc_id"]), *tuple(r)[1:]) for r in got)
        assert len(got) == len(want)
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:5] == w[:5]
            np.testing.assert_allclose(g[5:], w[5:], rtol=1e-9)


def test_classes_of_words_by_their_definition():
    rng = np.random.default_rng(3)
    words = [b"", b"a", b"ab", b"abc", b"hello", "é漢字".encode(), b"\xff\x00\x01", *(rng.integers(0, 256, i % 7, dtype=np.uint8).tobytes() for i in range(500))]
    assert lm.classes_of(pa.array(words, pa.binary())).tolist() == [lm.class_of(w) for w in words]
    assert lm.classes_of(pa.array(words, pa.binary())[3:]).tolist() == [lm.class_of(w) for w in words[3:]]
    assert lm.classes_of(pa.array([], pa.binary())).tolist() == []


def test_counts_hold_few_bytes_a_symbol_and_pairs_of_states_count_as_single_ones():
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, 50, n).astype("<u2") for n in rng.integers(1, 1500, 500)]
    shares = np.bincount(np.concatenate(texts), minlength=60) + 0.5
    shares /= shares.sum()
    three = lm.starting_model([], shares, states=3)
    to = np.array([0, 1, 2, 2])  # four states, the last two alike
    half = np.array([1, 1, 0.5, 0.5])
    four = lm.Model(three.start[to] * half, three.move[to][:, to] * half, three.emit[:, to])
    merged = np.eye(3)[to]
    for kind, near in ((np.float64, 1e-9), (np.float32, 1e-4)):
        want, got = (m.expected(texts, shares, kind) for m in (three, four))
        for x, y in zip((got[0] @ merged, merged.T @ got[1] @ merged, got[2] @ merged), want, strict=True):
            np.testing.assert_allclose(x, y, rtol=near, atol=near)
        np.testing.assert_allclose(got[2].sum(1), np.bincount(np.concatenate(texts), minlength=60), rtol=near)
    eight = lm.starting_model([], shares)
    tracemalloc.start()
    eight.expected(texts, shares, np.float32)
    most = tracemalloc.get_traced_memory()[1] / sum(map(len, texts))
    tracemalloc.stop()
    assert most < 100  # 40 for a symbol and its eight states; each further array of all times is 32 or more


def test_known_words_are_set_up_once_for_many_slices():
    sizes = [10, 1_500_000, 1_500_000, 0, 3_000_000, 9_000_000, 40_000_000, 5, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 3)), pa.array([None if n == 0 else "x" * n for n in sizes[i : i + 3]], pa.string())], names=["doc_id", "text"]) for i in (0, 3, 6)]
    got = [[b.column(0).to_pylist() for b in held] for held in lm.bunches(batches, "text")]
    assert got == [[[0, 1], [2], [3], [4], [5]], [[6]], [[7, 8]]]
    assert list(lm.bunches(batches[:0], "text")) == list(lm.bunches([batches[0].slice(0, 0)], "text")) == []
