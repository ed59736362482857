from collections import Counter

import corpus_pipeline
from barograph.llm import quality
from barograph.llm.common import table


def test_stages_take_effect(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "source_mixing", "best_fit_packing"]
    now, held = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns and now.count() > 0
        held[name] = Counter(r["doc_id"] for r in now.collect())
    good, single, cut, mixed = held.values()
    accepted = {r["doc_id"] for r in quality.report(docs, table(spark, sf_dir, "labels")).filter("predicted = 1").collect()}
    assert set(good) == accepted and set(single) < set(good) and set(cut) <= set(single) and set(mixed) <= set(cut)
    assert max(single.values()) == 1 and max(mixed.values()) == 2
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r["doc_id"] for r in pieces if r["piece"] == 0) == mixed


def test_stages_on_odd_and_empty_tables(spark, sf_dir, odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        if name != "best_fit_packing":
            assert out.columns == odd_docs.columns
        got = out.collect()
        kept[name] = [(r["doc_id"], r["text"]) if name != "best_fit_packing" else r["doc_id"] for r in got]
        none = stage(spark, odd_docs.limit(0), sf_dir)
        assert none.columns == out.columns and none.count() == 0
    accepted = Counter(r["doc_id"] for r in quality.report(odd_docs, table(spark, sf_dir, "labels")).filter("predicted = 1").collect())
    assert Counter(i for i, _ in kept["quality_classifier"]) == accepted and not Counter(kept["quality_classifier"]) - Counter(rows)
    # texts without words are one group, "one" is another, every other text stays; the smallest ids stand for groups
    assert sorted(kept["simhash_near_dedup"], key=repr) == sorted(((i, t) for i, t in rows if i not in (1, 2, 4)), key=repr)
    assert sorted((i for i, _ in kept["substring_dedup"]), key=repr) == sorted((i for i, _ in rows), key=repr)
    assert {t for i, t in kept["substring_dedup"] if i == 0} == {None} and all(len(t) < 100_000 for i, t in kept["substring_dedup"] if i == 6)
    assert not set(kept["source_mixing"]) - set(rows) and max(Counter(i for i, _ in kept["source_mixing"]).values()) <= 4
    assert set(kept["best_fit_packing"]) == {i for i, _ in rows} and Counter(kept["best_fit_packing"])[4] == 2


def test_labels_that_are_null_missing_or_of_one_kind_keep_all(spark, odd_docs, tmp_path):
    for k, labels in enumerate(([], [(0, None), (None, 1)], [(i, 0) for i in range(9)])):
        path = f"file://{tmp_path}/{k}"
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
        assert corpus_pipeline.quality_classifier(spark, odd_docs, path).count() == odd_docs.count()
