import math

import numpy as np
import regex
from pyspark.sql import functions as F

from barograph.llm import quality


def test_documents_stay_where_no_rule_can_be_fitted(spark, docs_of):
    docs = docs_of([(i, f"text number {i} of a clean kind.") for i in range(60)])
    labels = spark.createDataFrame([(i, 0) for i in range(60)], "doc_id long, quality int")
    assert quality.keep_good(docs, labels).count() == 60
    assert quality.keep_good(docs, labels.limit(3)).count() == 60


def test_few_rows_with_both_labels_fit_like_forty():
    x = np.concatenate([np.linspace(0, 1, 80), np.linspace(2, 3, 80)])[:, None]
    y = (x[:, 0] > 1.5).astype(float)
    for n in (39, 40, 20, 8):
        own = np.linspace(0, 159, n).astype(int)
        rules = quality.fit(x[own], y[own], ["a"])
        margin = quality.matches(x, rules.rules) @ np.array(rules.weights) + rules.bias
        assert rules.rules and ((margin > 0) == y).mean() > 0.95, n


def plain_statistics(text):
    """The statistics by plain Python."""
    text = text or ""
    words = [w for w in regex.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    n, chars = len(words), len(text)
    count = lambda p: len(regex.findall(p, text))
    return {
        "words": math.log1p(n), "word_length": share(chars, n), "words_a_line": share(n, len(lines)), "capitals": share(count(r"\p{Lu}"), chars),
        "digits": share(count("[0-9]"), chars), "bars": share(text.count("|"), n), "shouts": share(text.count("!"), n),
        "signs": share(sum(text.count(c) for c in "#$%&*@~^=_<>{}[]\\+/"), n), "stops": share(text.count(".") + text.count("?"), n),
        "commas": share(sum(text.count(c) for c in ",;:"), n), "distinct_words": share(len(set(words)), n), "distinct_lines": share(len(set(lines)), len(lines)),
        "letters": share(count(r"\p{L}"), chars),
    }


def test_statistics_and_scores_by_brute_force(spark, odd_docs, sf_dir):
    docs = odd_docs.select("text").union(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text"))
    names = list(plain_statistics(""))
    rng = np.random.default_rng(6)
    rules = [tuple((int(rng.integers(len(names))), bool(rng.random() < 0.5), float(rng.random() * 2)) for _ in range(k)) for k in (1, 2, 3, 3)]
    made = quality.Rules(names, rules, [0.7, -1.2, 0.4, 2.0], -0.3)
    found = quality.statistics(F.col("text"))
    assert list(found) == names
    for r in docs.withColumns(found).withColumn("_score", made.score()).collect():
        want = plain_statistics(r["text"])
        for name in names:
            assert abs(r[name] - want[name]) <= 1e-12 * max(1, abs(want[name])), (name, r["text"][:80])
        total = made.bias
        for rule, weight in zip(made.rules, made.weights, strict=True):
            total += weight * all((want[names[i]] > t) == above for i, above, t in rule)
        assert abs(r["_score"] - 1 / (1 + math.exp(-total))) < 1e-12
