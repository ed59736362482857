import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from barograph.llm import codes, exact, trie
from barograph.llm.queries import op11_prefix_trie, op12_progressive_dedup, op13_hamerly_codes

SPACES = re.compile(r"[\x20\x09-\x0D]+")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_groups(rows):
    """Expected rows of `exact.report` for (doc_id, text) rows."""
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[SPACES.sub(" ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i or 0))
        out += [(i, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=repr)


def check_exact(docs, rows, **how):
    assert sorted((tuple(r) for r in exact.report(docs, **how).collect()), key=repr) == plain_groups(rows)


def test_exact_dedup_of_odd_documents(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_exact(odd_docs, rows)


@pytest.mark.parametrize("bits", [32768, 1 << 24])
@pytest.mark.parametrize("prefix", [1, 64])
def test_exact_dedup_meets_groups_whatever_the_bitmap(docs_of, bits, prefix):
    rng = np.random.default_rng(4)
    rows = [(i, "".join(rng.choice(list("ab \n"), 5))) for i in range(600)] + [(1000 + i, "hot  copy" if i % 2 else "hot copy") for i in range(300)]
    rows += [(7, "same id"), (7, "same id"), (None, "same id"), (None, "only null"), (None, "only null"), (2000, "x" * 70 + "a"), (2001, "x" * 70 + "b")]
    check_exact(docs_of(rows), rows, bits=bits, prefix=prefix)


def test_exact_dedup_keeps_whole_rows(spark, docs_of):
    rows = [(3, "a  b", "s"), (1, "a b", "t"), (1, "a b", "t"), (None, "a\tb", "u"), (9, None, "s"), (8, "", "s"), (5, "own", None)]
    docs = docs_of(rows).withColumnsRenamed({"lang": "c.d", "score": "row"})
    kept = exact.deduplicate(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(1, "a b"), (5, "own"), (8, "")]
    assert exact.deduplicate(docs.limit(0)).count() == 0 and exact.report(docs.limit(0)).count() == 0


def test_exact_dedup_runs_without_python_workers(docs_of):
    plan = exact.report(docs_of(["a", "a"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def plain_trie(conversations):
    """Expected nodes, by whole prefixes, for rows of (conv_id, turn, role, text)."""
    talks = defaultdict(list)
    for c, turn, role, text in conversations:
        if c is not None:
            talks[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in talks.items()}
    whole = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + ts[h:]
    members = defaultdict(list)
    for c, ts in whole.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(cs) - 1) * len(WORDS.findall(p[-1][1])) if p else 0
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(cs) if len(whole[c]) == len(p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talk_frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, d int, `a.b` string")


def check_trie(spark, rows, **how):
    got = trie.report(talk_frame(spark, rows), **how)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_trie(rows)


def talks(seed, n=150, texts="abc", most=5):
    rng = np.random.default_rng(seed)
    return [(int(c), int(k), str(rng.choice(["user", "assistant"])), str(rng.choice(list(texts)))) for c in range(n) for k in range(int(rng.integers(0, most)))]


def test_trie_of_many_shared_prefixes(spark):
    check_trie(spark, talks(1, 400))


def test_trie_with_odd_rows(spark):
    rows = talks(2, 60) + [(c, None, None, None) for c in (0, 3, 3, 45)] + [(None, 0, "user", "a"), (-21, 0, "user", "a"), (-20, 0, "user", "b"), (999, 5, "", "")]
    rows += [(60, 0, "user", "w " * 50_000), (61, 0, "user", "w " * 50_000), (61, 0, "user", "w " * 50_000), (20, 0, "us", "era"), (20, 0, "use", "ra")]
    check_trie(spark, rows)
    assert trie.report(talk_frame(spark, [(1, 0, "u", "a")]).limit(0)).count() == 0


def test_trie_splits_groups_whose_fingerprints_collide(spark):
    check_trie(spark, talks(3, 60, "abcdef", 4), primes=(3, 2))


def test_trie_of_a_conversation_in_many_ranges(spark):
    """One conversation holds nearly all turns: its ranges' fingerprints and sums are carried over."""
    long = [(c, k, "user", f"t{k % 7}") for c in (40, 41) for k in range(500)] + [(41, 500, "user", "end")]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = trie.conversation_turns(talk_frame(spark, long)).withColumnRenamed("turn", "seq").selectExpr("*", "xxhash64(role, text) AS h")
        found, _ = trie.scanned(turns, ["conv_id", "seq"])
        assert found.filter("conv_id = 40").select("part").distinct().count() > 1
        a, b = ({r["d"]: (r["f"], r["up"]) for r in found.filter(f"conv_id = {c}").collect()} for c in (40, 41))
        assert len(a) == 500 and all(a[d] == b[d] for d in a) and all(b[d + 1][1] == b[d][0] for d in a)
        check_trie(spark, long + talks(4, 30))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_long_ends_are_hashed_in_order(spark):
    rows = [(c, 0, "user", "hi") for c in range(0, 9000, 7)] + [(10**12, 0, "user", "hi")]
    check_trie(spark, rows)


def plain_lloyd(rows, parts, entries, rounds):
    """(vec_id, codes, error) and books by full comparisons of Python integers."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = -(-max(len(v) for _, v in rows) // parts)
    cut = [[tuple((list(v) + [0] * (parts * width))[p * width : (p + 1) * width]) for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for k in range(rounds + 1):
        code = [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]
        if k == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, at in zip(cut, code, strict=True) if at[p] == e]
                if own:
                    books[p][e] = tuple(sum(x) // len(own) for x in zip(*own, strict=True))
    error = [sum(dist(c[p], books[p][at[p]]) for p in range(parts)) for c, at in zip(cut, code, strict=True)]
    return sorted(((i, tuple(at), e) for (i, _), at, e in zip(rows, code, error, strict=True)), key=repr), books


def check_codes(spark, rows, parts=2, entries=8, rounds=4):
    state = spark.createDataFrame([(i, 0, v) for i, v in rows], "vec_id long, label int, v array<long>")
    made = codes.train(state, parts, entries, rounds)
    want, books = plain_lloyd(rows, parts, entries, rounds)
    assert made.books.tolist() == [[list(e) for e in p] for p in books]
    error = {(r["vec_id"], r["code"], r["error"]) for r in codes.errors(made).collect()}
    assert sorted(error, key=repr) == sorted({(i, "".join(f"{c:02x}" for c in at), e) for i, at, e in want}, key=repr)
    return made


def test_codes_equal_full_comparisons(spark):
    rng = np.random.default_rng(7)
    check_codes(spark, [(int(i), rng.integers(-40, 40, 6).tolist()) for i in range(300)])
    check_codes(spark, [(int(i), rng.integers(-1, 2, 4).tolist()) for i in range(200)], entries=16)  # ties everywhere
    check_codes(spark, [(None, [1, 2]), (2, [3]), (2, [3]), (1, [-5, 7, 9])], entries=256)  # null, repeated, short
    check_codes(spark, [(int(i), rng.integers(-(2**25), 2**25, 4).tolist()) for i in range(60)])


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(-3, 3), min_size=2, max_size=2), min_size=1, max_size=40), st.integers(1, 6))
def test_bounds_never_change_an_assignment(vectors, entries):
    x = np.array(vectors)
    book = x[:entries].copy()
    code, upper, lower = codes.nearest(x, book)
    for _ in range(5):
        d = codes.squares(x, book)
        assert (code == d.argmin(1)).all()
        total = np.array([x[code == e].sum(0) for e in range(len(book))])
        count = np.bincount(code, minlength=len(book))
        new = np.where(count[:, None] > 0, total // np.maximum(count, 1)[:, None], book)
        code, upper, lower, _ = codes.assigned(x, new, codes.Moves.between(book, new), code, upper, lower)
        book = new


def test_bounds_spare_scans_where_vectors_form_clusters():
    rng = np.random.default_rng(8)
    centres = rng.integers(-10_000, 10_000, (16, 8))
    x = centres[rng.integers(0, 16, 4000)] + rng.integers(-50, 50, (4000, 8))
    book = centres + rng.integers(-200, 200, (16, 8))
    code, upper, lower = codes.nearest(x, book)
    new = np.array([x[code == e].sum(0) // max(1, (code == e).sum()) for e in range(16)])
    *_, scanned = codes.assigned(x, new, codes.Moves.between(book, new), code, upper, lower)
    assert scanned < len(x) // 10


def test_codes_drop_unsound_vectors_and_keep_labels(spark):
    rows = [(1, [0.5, -0.25, 0.0, 1.0], 3), (2, [0.5, float("nan"), 0.0, 1.0], 3), (3, None, 3), (4, [float("inf")] * 4, 1), (5, [0.1, None, 0.1, 0.1], 1), (6, [-0.0001, 0.3, 0.2, 0.1], None), (7, [9.0, 9.0, 9.0, 9.0], None)]
    vectors = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, code string")
    got = {r["vec_id"]: r for r in codes.report(vectors).collect()}
    assert set(got) == {1, 6, 7} and got[1]["label_error"] == got[1]["error"] and got[6]["label_error"] == got[6]["error"] + got[7]["error"]
    assert codes.report(vectors.limit(0)).count() == 0
    made = codes.train(codes.integers(vectors))
    near = {r["vec_id"]: r["v"] for r in codes.reconstruct(made.rows, made.books).collect()}
    assert near == {r["vec_id"]: r["v"] for r in made.rows.collect()}  # fewer vectors than entries: each has its own
    assert {r["vec_id"]: r["v"] for r in made.rows.collect()}[6] == [-1, 307, 204, 102]


def test_new_queries_run_over_whole_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert sorted((tuple(r) for r in op12_progressive_dedup(spark, sf_dir).collect()), key=repr) == plain_groups([tuple(r) for r in docs])
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert sorted((tuple(r) for r in op11_prefix_trie(spark, sf_dir).collect()), key=repr) == plain_trie([tuple(r) for r in said])
    assert op13_hamerly_codes(spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
