import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barograph.llm import packing, records, tokens

PLAIN = Tokenizer.from_file(tokens.default_path())
CODER = tokens.WordEncoder(tokens.default_path(), most=50)


def ids_of(text):
    return [*PLAIN.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab .,'İΣéñ<|>\ńAB9", max_size=40)), max_size=6))
def test_encoder_equals_the_library(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    got = CODER(pa.array(texts, pa.string()))
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [ids_of(t)[:-1] for t in texts]


def check_packing(rows, docs, capacity=4096):
    by_doc = {}
    for r in rows:
        by_doc.setdefault((r["doc_id"], r["start"], r["length"], r["ids_crc32"]), []).append(r)
    want = {}
    for i, text in docs:
        ids = np.array(ids_of(text), "<u4")
        for a in range(0, len(ids), capacity):
            key = (i, a, len(ids[a : a + capacity]), zlib.crc32(ids[a : a + capacity].tobytes()))
            want[key] = want.get(key, 0) + 1
    assert {k: len(v) for k, v in by_doc.items()} == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_of_odd_and_whole_tables(spark, odd_docs, sf_dir):
    odd = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    check_packing(packing.pack(odd_docs).collect(), odd)
    assert packing.pack(odd_docs.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = packing.pack(docs).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert n <= -(-sum(r["length"] for r in rows) // 4096) + 1


def test_packed_ids(docs_of):
    docs = docs_of(["a b c", "d e", "f " * 30])
    rows = packing.pack(docs, capacity=16, with_ids=True)
    got = {r["sequence_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in packing.sequences(rows).collect()}
    for r in rows.collect():
        whole = ids_of(docs.filter(f"doc_id = {r['doc_id']}").first()["text"])
        assert got[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == whole[r["start"] : r["start"] + r["length"]]


def used(counts, capacity):
    plan = packing.make_plan(dict(counts), capacity)
    load, ranks = {}, {}
    for length, start, first, each, offset in sorted(plan.runs):
        total = plan.used[length]
        nxt = min([s for n, s, *_ in plan.runs if n == length and s > start], default=total)
        assert start == ranks.get(length, 0)
        ranks[length] = nxt
        for k in range(nxt - start):
            load.setdefault(first + k // each, []).append((offset + k % each * length, length))
    assert ranks == {k: n for k, n in counts.items() if n}
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.sequences


def optimum(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, loads):
        if len(loads) >= best[0]:
            return
        if i == len(items):
            best[0] = len(loads)
            return
        for k in {v: k for k, v in enumerate(loads)}.values():
            if loads[k] + items[i] <= capacity:
                loads[k] += items[i]
                go(i + 1, loads)
                loads[k] -= items[i]
        loads.append(items[i])
        go(i + 1, loads)
        loads.pop()

    go(0, [])
    return best[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_plans_are_sound_and_nearly_least(items):
    counts = {x: items.count(x) for x in set(items)}
    least = optimum(items, 20)
    assert least <= used(counts, 20) <= least + 1


@pytest.mark.parametrize("low,high,n,most", [(1300, 1500, 20_000, 8000), (900, 1400, 5000, 1470), (1000, 1366, 20_000, 6470), (600, 900, 20_000, 3760), (1, 4097, 20_000, 10_080)])
def test_plans_of_crowded_lengths_are_near_the_bound(low, high, n, most):
    drawn = Counter(np.random.default_rng(1).integers(low, high, n).tolist())
    need = used(drawn, 4096)
    bound = packing.least_sequences(dict(drawn), 4096)
    assert bound <= need <= most


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_lower_bound_is_one(items):
    assert packing.least_sequences(Counter(items), 20) <= optimum(items, 20)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=14), st.integers(2, 5))
@settings(max_examples=100, deadline=None)
def test_sequences_of_a_number_of_pieces_are_sound(items, k):
    plan = packing.Plan(20)
    rest = packing.fill_by_number(dict(Counter(items)), plan, k)
    assert sum(rest.values()) + k * plan.sequences == len(items) and not any(n <= 0 for n in rest.values())
    load = Counter()
    for length, _, first, each, offset in plan.runs:
        assert each == 1 and offset + length <= 20
        load[first] = max(load[first], offset + length)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(5, 20), min_size=1, max_size=9))
def test_dominance_reduction_keeps_the_optimum(items):
    """What the reduction fixes, and an optimal packing of the rest, is an optimal packing."""
    plan = packing.Plan(20)
    left = packing.reduce_by_dominance({x: items.count(x) for x in set(items)}, plan)
    rest = [x for x, n in left.items() for _ in range(n)]
    assert plan.sequences + (optimum(rest, 20) if rest else 0) == optimum(items, 20)


def test_records_round_trip(spark, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = records.encode_documents(odd_docs, file_bytes=200_000)
    got = sorted(got.collect(), key=lambda r: r["start"])
    want, at = {}, 0
    for i, text in rows:
        ids = np.array(ids_of(text), "<u4").tobytes()
        want.setdefault(i, []).append((len(ids) // 4, zlib.crc32(ids)))
    assert [r["doc_id"] for r in got] == sorted([i for i, _ in rows], key=lambda i: (i is not None, i))
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
        want[r["doc_id"]].remove((r["n_tokens"], r["ids_crc32"]))
    assert records.encode_documents(odd_docs.limit(0)).count() == 0


def test_shuffled_reads_use_the_index(spark, docs_of, tmp_path):
    docs = docs_of([f"text number {i} with words" for i in range(50)])
    path = f"file://{tmp_path}/rec"
    records.write_records(docs, path, file_bytes=500)
    index = records.write_index(spark, path, path + "-index")
    assert index.select("file").distinct().count() > 1
    one, two, again = (records.read_shuffled(spark, path, index, seed).collect() for seed in (1, 2, 1))
    assert [r["doc_id"] for r in one] == [r["doc_id"] for r in again] != [r["doc_id"] for r in two]
    assert {r["doc_id"]: np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in one} == {i: ids_of(f"text number {i} with words") for i in range(50)}
    few = records.read_shuffled(spark, path, index.filter("doc_id < 5"), 1).collect()
    assert sorted(r["doc_id"] for r in few) == [0, 1, 2, 3, 4]


def test_damaged_records_are_found():
    good = records.frame(records.encode_body(7, np.array([1, 70_000], "<u4").tobytes())) + b"\n"
    assert [records.decode_body(b) for _, b in records.frames(good + good)] == [(7, np.array([1, 70_000], "<u4").tobytes())] * 2
    for at in range(len(good)):
        bad = bytearray(good)
        bad[at] ^= 0x40
        with pytest.raises(ValueError):
            list(records.frames(bytes(bad)))
    with pytest.raises(ValueError):
        list(records.frames(good[:-3]))


def test_words_of_earlier_batches_are_not_encoded_again():
    coder, asked = tokens.WordEncoder(tokens.default_path()), []
    together = coder.together
    coder.together = lambda words, runs: asked.append(len(words)) or together(words, runs)
    letters = "abcdefghijklmnopqrstuvwxyz"
    many = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:12]]
    one, two = pa.array([" ".join(many[:105_000])]), pa.array([" ".join(many[105_000:])])
    first = coder(one)
    coder(two)
    coder(pa.array(["again"]))
    assert coder(one) == first and asked[0] == 105_000 and asked[3] == 0


def test_strings_by_way_of_one():
    for words in ([], [""], ["a"], ["", "é", "", "\U0001f600\x85", ""]):
        assert tokens.unpacked(pa.array(words, pa.string())) == words
    assert tokens.unpacked(pa.array(["x", "", "y"])[1:]) == ["", "y"]
