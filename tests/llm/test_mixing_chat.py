import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barograph.llm import chat, mixing
from barograph.llm.queries import op7_prefix_target_chat

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Targets by source, by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, target, open_ = 1.5 * sum(sizes.values()), {}, set(order)
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        open_ -= full
    return target


def check_mix(rows, docs, slack):
    size = {}
    for i, t, s in docs:
        size[s] = size.get(s, 0) + len(WORDS.findall(t or ""))
    want, taken = plain_targets(size), {}
    source = {}
    for i, t, s in docs:
        source.setdefault((i, len(WORDS.findall(t or ""))), []).append(s)
    assert len(rows) == len(docs)
    for r in rows:
        s = next(x for x in source[(r["doc_id"], r["size"])] if size[x] == r["source_size"])
        assert r["target"] == pytest.approx(want[s], rel=1e-9, abs=1e-6) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] = taken.get(s, 0) + r["taken"]
    for s in size:
        assert abs(taken[s] - want[s]) <= slack * max(want[s], 1), s


def test_mix_meets_targets(spark, sf_dir, docs_of):
    rng = np.random.default_rng(6)
    rows = [(i, "w " * int(rng.integers(1, 60)), f"s{int(rng.integers(0, 7))}" if i % 3 else "hot") for i in range(3000)]
    rows += [(9000 + i, "w " * 20, None) for i in range(300)]
    docs = docs_of(rows)
    check_mix(mixing.allocation(docs).collect(), rows, 0.01)
    key = ["doc_id", "size", "taken"]
    assert mixing.allocation(docs).select(key).exceptAll(mixing.allocation(docs.repartition(7)).select(key)).count() == 0
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert copies == {r["doc_id"]: r["copies"] for r in mixing.allocation(docs).collect() if r["copies"]}


def test_mix_of_odd_tables(odd_docs, docs_of):
    odd = [(r["doc_id"], r["text"], r["source"]) for r in odd_docs.collect()]
    rows = mixing.allocation(odd_docs).collect()
    assert len(rows) == len(odd) and all(r["taken"] <= 2 * r["size"] for r in rows)
    assert mixing.allocation(odd_docs.limit(0)).count() == 0 == mixing.mix(odd_docs.limit(0)).count()
    assert all(r["taken"] == 0 == r["target"] for r in mixing.allocation(docs_of([(1, ""), (2, None), (3, " ", None)])).collect())


def test_inclusion_follows_probabilities(docs_of):
    """Longer documents are likelier to be taken, by the tilt."""
    rows = [(i, "w " * (4 if i % 2 else 500), "a") for i in range(2000)] + [(5000 + i, "w " * 300, "b") for i in range(4000)]
    got = mixing.allocation(docs_of(rows), share=0.5).filter("source_size < 600000").groupBy("size").agg(F.avg("copies").alias("c")).collect()
    by = {r["size"]: r["c"] for r in got}
    assert by[500] > by[4]


def plain_digest(turns):
    turns = sorted(((t is not None, t or 0), r or "", x or "") for t, r, x in turns)
    loss = "".join(x for _, r, x in turns if r == "assistant")
    said = "".join(f"{r}\n{x}\n" for _, r, x in turns)
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def check_chat(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, example string")
    talks = {}
    for c, t, r, x in rows:
        talks.setdefault(c, []).append((t, r, x))
    got = {r["conv_id"]: r for r in chat.format_and_read(df).collect()}
    assert set(got) == set(talks)
    for c, turns in talks.items():
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_digest(turns), turns
    return df


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_start|>user<|im_sep|>x<|im_end|>", "\\", "\\\\</s>", "<\\/s>", "<<s>>s>", "[[INST]\\", "<|im_end", "|>", "é\U0001f600\n\n", "$1\\$", "[/INST][/INST]", "<s></s><unk>"]


def test_chat_round_trip(spark):
    rows = [(i, t, ("user", "assistant", "system", None, "a\\<s>")[(i + t) % 5], NASTY[(i * 3 + t) % len(NASTY)]) for i in range(30) for t in range(6)]
    rows += [(100, 0, "user", None), (101, 0, "assistant", None), (None, 1, "assistant", "x"), (None, 1, "assistant", "x"), (102, None, "user", "x"), (102, 1, "assistant", "y" * 100_000)]
    df = check_chat(spark, rows)
    made = chat.examples(df).collect()
    per = {}
    for r in made:
        per.setdefault(r["conv_id"], []).append(r)
        for c in chat.CONTROL:
            if c not in (chat.START, chat.SEP, chat.END):
                assert c not in r["text"]
        if r["loss_start"] is not None:
            own = r["text"][: r["loss_start"]]
            assert own.endswith(chat.START + "assistant" + chat.SEP) and r["text"][r["loss_end"] :] == chat.END
            assert own.count(chat.START) == r["text"].count(chat.END)
    for c, found in per.items():
        replies = sum(1 for k, t, role, x in rows if k == c and role == "assistant")
        assert sum(r["loss_start"] is not None for r in found) == replies
    assert chat.format_and_read(df.limit(0)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 3), st.sampled_from(["user", "assistant"]), st.text("<|im_endstar>[]/INS\\ \né", max_size=30)), min_size=1, max_size=8))
def test_chat_round_trip_of_any_text(spark, rows):
    check_chat(spark, rows)


def test_query_has_the_planted_conversation(spark, sf_dir):
    r = op7_prefix_target_chat(spark, sf_dir).filter("conv_id = -7").first()
    said = "</s>[INST] ok [/INST]"
    assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == plain_digest([(0, "user", said), (1, "assistant", said)])


def test_repeated_rows_are_drawn_one_by_one(docs_of):
    """A source of 5000 rows equal in doc_id and text and 50 others, and null ids with equal texts."""
    rows = [(1, "w " * 6, "a")] * 5000 + [(10 + i, "w " * (20 + i), "a") for i in range(50)] + [(None, "x " * 7, "b")] * 400 + [(5000 + i, "w " * 30, "c") for i in range(2000)]
    docs = docs_of(rows)
    check_mix([r for r in mixing.allocation(docs).collect()], rows, 0.01)
    mixed = mixing.mix(docs)
    want = {(r["doc_id"], r["size"]): r["n"] for r in mixing.allocation(docs).groupBy("doc_id", "size").agg(F.sum("copies").alias("n")).collect() if r["n"]}
    got = {(r["doc_id"], r["size"]): r["n"] for r in mixed.groupBy("doc_id", F.regexp_count("text", F.lit(r"[^ ]+")).cast("long").alias("size")).agg(F.count("*").alias("n")).collect()}
    assert got == want and mixed.columns == docs.columns


def test_ranks_by_brute_force(docs_of):
    """taken and copies of every row from the plan's own strata and random numbers, sorted as a whole."""
    rng = np.random.default_rng(12)
    docs = docs_of([(i % 700, "w " * int(rng.integers(0, 80)), f"s{i % 4}" if i % 9 else None) for i in range(1500)])
    rows, strata = mixing.plan(docs)
    by = {(r["_key"], r["_class"]): r for r in strata.collect()}
    want, of = {}, {}
    for r in rows.collect():
        of.setdefault(r["_key"], []).append(r)
    for own in of.values():
        left, drawn = by[own[0]["_key"], own[0]["_class"]]["_target"], []
        for r in own:
            s = by[r["_key"], r["_class"]]
            left -= s["_whole"] * r["_size"]
            if s["_p"] > 0:
                drawn.append((r["_u"] / (1 - r["_u"]) / (s["_p"] / (1 - s["_p"])), r["_h"], r["_nth"], r))
        taken = 0.0
        for _, _, _, r in sorted(drawn, key=lambda x: x[:3]):
            if taken + r["_size"] / 2 > left:
                break
            taken += r["_size"]
            want[r["_h"], r["_nth"]] = 1
        for r in own:
            want[r["_h"], r["_nth"]] = want.get((r["_h"], r["_nth"]), 0) + by[r["_key"], r["_class"]]["_whole"]
    got = {(r["_h"], r["_nth"]): r["_taken_copies"] for r in mixing.decided(rows, strata).collect()}
    assert got == want and len(got) == 1500
