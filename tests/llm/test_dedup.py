import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from barograph.llm import components, fingerprints, neardup, substring


def plain_simhash(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text("ab cÀZ\n\x0b\xa0", max_size=60))
def test_simhash_by_definition(text):
    assert neardup.simhash(text) == plain_simhash(text)


def roots(items, linked):
    parent = {x: x for x in items}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = sorted(items)
    for i, a in enumerate(items):
        for b in items[i + 1 :]:
            if linked(a, b):
                parent[find(b)] = find(a)
    return {x: find(x) for x in items}


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(-(2**63), 2**63 - 1, 40)]
    fps = {0, -1, *base}
    for b in base:
        for n in (1, 2, 3, 4):
            for _ in range(3):
                mask = sum(1 << int(i) for i in rng.choice(64, n, replace=False))
                x = (b & (2**64 - 1)) ^ mask
                fps.add(x - 2**64 if x >> 63 else x)
    fps = sorted(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    got = [tuple(r) for r in neardup.links(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    got = [tuple(r) for r in fingerprints.within(df, 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(5, 5), (1, 2), (2, 1), (1, 2)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in range(20, 60)} | {7: 7, 1: 1, 2: 1}
    assert got == want
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicate_groups(spark, odd_docs, sf_dir):
    for docs in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
        fp = {t: plain_simhash(t) for _, t in rows}
        root = roots(set(fp.values()), lambda a, b: (a ^ b).bit_count() <= 3)
        least = {}
        for i, t in rows:
            if i is not None:
                least[root[fp[t]]] = min(least.get(root[fp[t]], i), i)
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in neardup.report(docs).collect()), key=repr)
        assert got == sorted(((i, f"{fp[t]:016x}", least.get(root[fp[t]])) for i, t in rows), key=repr)
        kept = neardup.deduplicate(docs)
        assert kept.columns == docs.columns and kept.count() == len(set(root.values()))
    assert neardup.report(odd_docs.limit(0)).count() == 0 and neardup.deduplicate(odd_docs.limit(0)).count() == 0


def test_fingerprints_of_edited_texts(spark, docs_of):
    import hashlib

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefgé"), 5)) for _ in range(300)]
    texts = [" ".join(rng.choice(words, n)) for n in (0, 1, 2, 5, 40, 400, 400, 3000)] + ["\U0001f600 漢字 x " * 50]
    for rows in ([(3 * i, t) for i, t in enumerate(texts)], [(1, "only one here")], [(None, "a b c d e"), (2, None), (2, None)]):
        got = fingerprints.report(docs_of(rows)).collect()
        assert len(got) == len(rows)
        for k, (i, t) in enumerate(rows):
            if rows[0][0] is None:
                continue
            t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
            edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
            r = next(r for r in got if r["doc_id"] == i)
            assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
            other = next(x for x in got if x["doc_id"] == rows[(k + 1) % len(rows)][0])
            bits = int(r["fingerprint"], 16) ^ int(other["fingerprint"], 16)
            assert r["near_next"] == 1 - bits.bit_count() / 64
            if len(t) > 150:
                assert r["near_edited"] > r["near_next"]
    assert fingerprints.report(docs_of([]), 3).count() == 0


def test_fingerprints_by_brute_force(spark, docs_of):
    """Every column against plain Python, on null, empty, repeated, tied and long rows."""
    import hashlib

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgé"), 4)) for _ in range(60)]
    long = " ".join(rng.choice(words, 500))
    rows = [(None, "no id"), (None, "no id"), (None, "another"), (-5, ""), (0, None), (1, " \n "), (2, "one"), (2, "one"), (2, "one"), (2, "two words"), (3, long), (4, long + " more"), (4, "x" * 9000)]
    rows += [(5, "abcd ef"), (6, "a b c d e f g h"), (7, "\U0001f600 漢字 ΟΔΟΣ x y " * 9), (9, long), (2**62, "word " * 3000)]
    rows += [(100 + i, " ".join(rng.choice(words, int(n)))) for i, n in enumerate(rng.integers(1, 40, 120))]

    texts = {t or "" for _, t in rows}
    ties = dict(tuple(r) for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t)").collect())
    ordered = sorted(((i is not None, i or 0, ties[t or ""], t or "") for i, t in rows), key=lambda r: r[:3])
    pairs = [(i if known else None, t, ordered[(k + 1) % len(ordered)][3]) for k, (known, i, _, t) in enumerate(ordered)]
    edited = [t[: len(t) - len(t) // 4] + after[: len(t) // 4] for _, t, after in pairs]

    def terms(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
        return list(zip(ws, ws[1:], strict=False)) or [(w, None) for w in ws]

    wanted = sorted({x for t in [*texts, *edited] for x in terms(t)}, key=repr)
    hashes = {(r["a"], r["b"]): r["h"] for r in spark.createDataFrame(wanted, "a string, b string").selectExpr("a", "b", "xxhash64(a, b) h").collect()}

    def plain(text):
        hs = np.array([hashes[x] for x in terms(text)], "<i8")
        bits = np.unpackbits(hs.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int) if len(hs) else np.zeros(64, int)
        return sum(1 << i for i in range(64) if 2 * bits[i] > len(hs))

    fp = {t: plain(t) for t in {*texts, *edited}}
    alike = lambda a, b: 1 - (a ^ b).bit_count() / 64
    near = {a: sum(0 < (a ^ b).bit_count() <= 3 for b in {fp[t] for t in texts}) for a in fp.values()}
    want = [
        (i, len(t), hashlib.sha256(e.encode()).hexdigest(), f"{fp[t]:016x}", f"{fp[e]:016x}", alike(fp[t], fp[e]), alike(fp[t], fp[after]), near[fp[t]])
        for (i, t, after), e in zip(pairs, edited, strict=True)
    ]
    got = [tuple(r) for r in fingerprints.report(docs_of(rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert [tuple(r)[:2] for r in fingerprints.report(docs_of([(1, "a")] * 5000).repartition(3)).collect()] == [(1, 1)] * 5000


def test_fingerprint_votes_over_several_stretches(docs_of, spark):
    text = " ".join(f"w{i % 977}x{i % 13}" for i in range(95_000))
    got = fingerprints.report(docs_of([(1, text), (2, text.upper())])).collect()
    lowered = text.split()
    terms = spark.createDataFrame([(a, b) for a, b in zip(lowered, lowered[1:], strict=False)], "a string, b string").selectExpr("xxhash64(a, b) h").collect()
    bits = np.unpackbits(np.array([r["h"] for r in terms], "<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    want = f"{sum(1 << i for i in range(64) if 2 * bits[i] > len(terms)):016x}"
    assert {r["fingerprint"] for r in got} == {want}


def test_chunks_cover_texts_and_resist_shifts():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghé"), rng.integers(1, 9))) for _ in range(400)]
    passage = " ".join(rng.choice(words, 80))
    texts = [passage, "new start. " + passage, "  " + passage + "\n", None, "", "\n \t", "a\x00b c", "one " * 1000]
    data, doc, start, stop, n = substring.chunk_texts(texts)
    for i, t in enumerate(texts):
        own = [data[a:b] for a, b, d in zip(start, stop, doc, strict=True) if d == i]
        assert b"".join(own) == (t or "").encode().lstrip(b" \n\t")
        assert n[doc == i].sum() == len((t or "").encode().split())
    first, second = ({data[a:b].strip() for a, b, d in zip(start, stop, doc, strict=True) if d == i} for i in (0, 1))
    assert len(first - second) <= 2


def test_repeated_passages_go_once(docs_of):
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefghijklmno"), 6))
    prose = lambda n: " ".join(word() for _ in range(n))
    planted = [prose(60) for _ in range(6)]
    rows = [(i, f"{prose(40)} {planted[i % 6]}\n{prose(40)}") for i in range(40)]
    clean = [(100 + i, prose(120)) for i in range(20)]
    got = {r["doc_id"]: r for r in substring.report(docs_of(rows + clean)).collect()}
    texts = dict(rows + clean)
    for i in range(40):
        assert (got[i]["removed_words"] > 0) == (i >= 6)
        if i >= 6:
            assert 30 <= got[i]["removed_words"] <= 61 and planted[i % 6] not in got[i]["text"]
        kept, at = "", 0
        for s in got[i]["removed_spans"]:
            kept, at = kept + texts[i][at : s["start"]], s["stop"]
        assert kept + texts[i][at:] == got[i]["text"]
    assert all(got[i]["text"] == t and not got[i]["removed_words"] for i, t in clean)
    whole = substring.deduplicate(docs_of(rows + [(500, rows[0][1])]))
    assert whole.columns == docs_of([]).columns
    assert 500 not in {r["doc_id"] for r in whole.collect() if r["text"].strip()} or whole.filter("doc_id = 500").first()["n_chars"] < 200


def test_substring_dedup_of_odd_texts(odd_docs):
    got = substring.report(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[0]["text"] is None and by[2]["text"] == " \n\t " and by[3]["text"] == by[4]["text"] == "one"
    assert by[6]["removed_words"] > 60_000 and by[7]["text"] == "x" * 300_000
    assert substring.report(odd_docs.limit(0)).count() == 0 and substring.deduplicate(odd_docs.limit(0)).count() == 0


def test_repeats_are_seen_through_white_space_and_among_null_ids(docs_of):
    rng = np.random.default_rng(15)
    prose = lambda n: ["".join(rng.choice(list("abcdefghijklmno"), 6)) for _ in range(n)]
    passage = prose(80)
    rows = [(1, " ".join([*prose(30), *passage])), (2, " ".join(prose(30)) + "\n" + "\n".join(passage)), (3, "  ".join([*passage, *prose(30)]))]
    rows += [(None, " ".join([*prose(10), *passage])), (None, " ".join(prose(50)))]
    got = substring.report(docs_of(rows)).collect()
    removed = {r["doc_id"]: r["removed_words"] for r in got if r["doc_id"] is not None}
    assert removed[1] == 0 and all(60 <= removed[i] <= 81 for i in (2, 3))
    assert sorted(r["removed_words"] > 60 for r in got if r["doc_id"] is None) == [False, True]


def test_repeated_windows_by_brute_force(spark):
    """Of all 50-word windows of the documents that an earlier document (or place) has, nearly none stays, and
    nothing goes but words in a window of 25 that was there before."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    got = {r["doc_id"]: r for r in substring.report(docs).collect()}
    seen, first = set(), {}
    repeated = stay = wrong = removed = 0
    for i, text in rows:
        words = [(m.start(), m.end(), m.group()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
        spans = got[i]["removed_spans"]
        gone = [any(s["start"] <= a and b <= s["stop"] for s in spans) for a, b, _ in words]
        assert sum(gone) == got[i]["removed_words"]
        covered = [False] * len(words)
        for k in range(len(words) - 11):
            key = tuple(w for _, _, w in words[k : k + 12])
            if first.setdefault(key, (i, k)) != (i, k):
                covered[k : k + 12] = [True] * 12
        removed += sum(gone)
        wrong += sum(g and not c for g, c in zip(gone, covered, strict=True))
        own = [hash(tuple(w for _, _, w in words[k : k + 50])) for k in range(len(words) - 49)]
        for k, h in enumerate(own):
            if h in seen:
                repeated += 1
                stay += not any(gone[k : k + 50])
            seen.add(h)
    assert repeated > 300 and stay <= 0.01 * repeated, (repeated, stay)
    assert wrong <= 0.002 * removed, (removed, wrong)


@pytest.fixture
def small_broadcasts(spark):
    """No broadcast of over 2 MB, while Spark's usual threshold of 10 MB of estimated size holds for joins."""
    names = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": str(2 << 20)}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_variants_do_not_pass_through_the_driver(spark, docs_of, small_broadcasts):
    docs = docs_of([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(4000)])
    assert {r["component_id"] for r in neardup.report(docs).collect()} == set(range(4000))
