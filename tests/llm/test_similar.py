import numpy as np

import corpus_pipeline
from barograph.llm import similar


def plain(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def alike(a, b):
    return a == b or 5 * len(a & b) >= 4 * len(a | b)


def test_pipeline_stage_finds_near_copies_by_brute_force(spark, docs_of, odd_docs, sf_dir):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(5000)]
    planted = []
    for i in range(60):  # originals, copies with 1 to 8 words of 200 replaced, which are from 0.95 to 0.66 alike
        own = list(rng.choice(words, 200))
        planted.append((2 * i, " ".join(own)))
        for at in rng.choice(np.arange(5, 195), 1 + i % 8, replace=False):
            own[at] = "changed"
        planted.append((2 * i + 1, " ".join(own).upper() + " "))
    crowd = list(rng.choice(words, 120))  # every document with the line is far from the others
    planted += [(1000 + i, " ".join([*crowd[:60], *rng.choice(words, 60)])) for i in range(40)]
    tables = [docs_of(planted), odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for docs in tables:
        rows = [(r["doc_id"], plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
        sets = list({s for _, s in rows})
        group = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j in range(i):
                if group[i] != group[j] and 5 * min(len(a), len(sets[j])) >= 4 * max(len(a), len(sets[j])) and alike(a, sets[j]):
                    group = [group[j] if g == group[i] else g for g in group]
        of = dict(zip(sets, group, strict=True))
        least = {}
        for i, s in rows:
            least[of[s]] = min((x for x in (least.get(of[s]), i) if x is not None), default=None)
        got = corpus_pipeline.STAGES[1][1](spark, docs, sf_dir)
        assert got.columns == docs.columns
        assert sorted(map(repr, (r["doc_id"] for r in got.collect()))) == sorted(map(repr, least.values()))
    kept = {r["doc_id"] for r in corpus_pipeline.STAGES[1][1](spark, tables[0], sf_dir).collect()}
    assert 15 < 160 - len(kept) < 60 and all(1000 + i in kept for i in range(40))
    assert corpus_pipeline.STAGES[1][1](spark, tables[0].limit(0), sf_dir).count() == 0


def test_stage_sends_no_band_keys_through_the_driver(spark, docs_of, monkeypatch):
    """The table of shared band keys is made without a broadcast of over 2 MB, at Spark's usual threshold of estimated sizes."""
    real, seen = similar.materialize, []
    names = {"spark.sql.autoBroadcastJoinThreshold": "10m", "spark.sql.maxBroadcastTableSize": str(2 << 20)}

    def limited(df, name):
        if name != "members":
            return real(df, name)
        seen.append(name)
        before = {k: spark.conf.get(k) for k in names}
        try:
            for k, v in names.items():
                spark.conf.set(k, v)
            return real(df, name)
        finally:
            for k, v in before.items():
                spark.conf.set(k, v)

    monkeypatch.setattr(similar, "materialize", limited)
    docs = docs_of([(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(4000)])
    assert corpus_pipeline.STAGES[1][1](spark, docs, "").count() == 4000 and seen == ["members"]
