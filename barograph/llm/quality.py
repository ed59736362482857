"""A quality classifier from a sparse rule ensemble over text statistics.

Shallow boosted trees are grown on a bounded sample of labelled documents; each path from a root to
a node is a conjunction of thresholds. A logistic model with an L1 penalty weighs these rules and
sets most weights to zero. What is left is compiled into Spark columns, so scoring a corpus is one
projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, whole_row

#: Labelled documents that train (picked by a hash of their ids), at most.
SAMPLE = 12_000
TREES, DEPTH, BINS, RATE, PENALTY = 24, 3, 48, 0.3, 0.002
KEEP_AT = 0.3


def statistics(text: Column) -> dict[str, Column]:
    """The statistics that rules may use. All are defined (zero) for empty texts."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    share = lambda part, whole: F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
    chars, n, n_lines = F.length(text), F.size(words), F.size(lines)
    return {
        "words": F.log1p(n.cast("double")),
        "word_length": share(chars, n),
        "words_a_line": share(n, n_lines),
        "capitals": share(count(r"\p{Lu}"), chars),
        "digits": share(count(r"[0-9]"), chars),
        "bars": share(count(r"\|"), n),
        "shouts": share(count(r"!"), n),
        "signs": share(count(r"[#$%&*@~^=_<>{}\[\]\\+/]"), n),
        "stops": share(count(r"[.?]"), n),
        "commas": share(count(r"[,;:]"), n),
        "distinct_words": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "letters": share(count(r"\p{L}"), chars),
    }


@dataclass
class Rules:
    names: list[str]
    rules: list[tuple[tuple[int, bool, float], ...]]  # (statistic, above, threshold) joined by AND
    weights: list[float]
    bias: float

    def score(self) -> Column:
        """The probability of label 1 as a column over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            parts = [F.col(self.names[i]) > t if above else F.col(self.names[i]) <= t for i, above, t in rule]
            hit = parts[0]
            for p in parts[1:]:
                hit = hit & p
            total = total + F.when(hit, F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def leaf_rows(n: int) -> int:
    """Rows that a side of a split has at least, of n in all: 15, and in proportion below 40 rows."""
    return min(15, n * 15 // 40)


def grow(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int) -> tuple[list, np.ndarray]:
    """One tree of Newton steps: its paths as rules, and its prediction for every row."""
    paths, out, least = [], np.zeros(len(grad)), leaf_rows(len(grad))

    def split(rows: np.ndarray, rule: tuple, left: int) -> None:
        out[rows] = -grad[rows].sum() / (hess[rows].sum() + 1.0)
        if not left or len(rows) < min(40, len(grad)):
            return
        best = (1e-3, None, None)
        g, h = grad[rows].sum(), hess[rows].sum()
        for f in range(binned.shape[1]):
            code = binned[rows, f]
            gl = np.cumsum(np.bincount(code, grad[rows], len(edges[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(code, hess[rows], len(edges[f]) + 1))[:-1]
            n = np.cumsum(np.bincount(code, minlength=len(edges[f]) + 1))[:-1]
            gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
            gain[(n < least) | (n > len(rows) - least)] = -1
            if len(gain) and gain.max() > best[0]:
                best = (gain.max(), f, int(gain.argmax()))
        if best[1] is None:
            return
        _, f, k = best
        for above in (False, True):
            own = rule + ((f, above, float(edges[f][k])),)
            paths.append(own)
            split(rows[(binned[rows, f] > k) == above], own, left - 1)

    split(np.arange(len(grad)), (), depth)
    return paths, out


def matches(x: np.ndarray, rules: list) -> np.ndarray:
    hit = np.ones((len(x), len(rules)), np.float32)
    for j, rule in enumerate(rules):
        for f, above, t in rule:
            hit[:, j] *= (x[:, f] > t) == above
    return hit


def lasso(hit: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """L1 logistic weights by accelerated proximal gradient; the bias is free."""
    center = hit.mean(0)
    z = (hit - center).astype(np.float32)
    v = np.ones(z.shape[1], np.float32)
    for _ in range(12):  # largest eigenvalue of the quadratic bound
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v) + 1e-12
    size = 1.0 / (float(np.linalg.norm(z @ v)) ** 2 / len(y) / 4 * 1.1 + 0.25)
    w, w0 = np.zeros(z.shape[1], np.float32), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    u, u0, t = w.copy(), w0, 1.0
    for _ in range(steps):
        r = (1 / (1 + np.exp(-(z @ u + u0))) - y).astype(np.float32)
        new = u - size * (z.T @ r) / len(y)
        new, new0 = np.sign(new) * np.maximum(np.abs(new) - size * penalty, 0), u0 - size * float(r.mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        u, u0 = new + (t - 1) / t2 * (new - w), new0 + (t - 1) / t2 * (new0 - w0)
        w, w0, t = new, new0, t2
    return w.astype(float), w0 - float(center @ w)


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> Rules:
    """Rules from statistics x (rows by names) and labels y (0 or 1). One label only, or fewer than 8 rows,
    gives a constant score without rules."""
    mean = float(y.mean()) if len(y) else 0.5
    constant = Rules(names, [], [], float(np.log((mean + 1e-3) / (1 - mean + 1e-3))))
    if leaf_rows(len(y)) < 3 or mean in (0.0, 1.0):
        return constant
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    margin, rules = np.full(len(y), constant.bias), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, step = grow(binned, edges, p - y, np.maximum(p * (1 - p), 1e-4), depth)
        rules.update(dict.fromkeys(tuple(sorted(r)) for r in paths))
        margin += RATE * step
    rules = list(rules)
    if not rules:
        return constant
    hit = matches(x, rules)
    _, first = np.unique(hit, axis=1, return_index=True)  # rules that say the same
    rules = [rules[i] for i in sorted(first)]
    weights, bias = lasso(hit[:, sorted(first)], y, penalty)
    used = [i for i, w in enumerate(weights) if abs(w) > 1e-4]
    return Rules(names, [rules[i] for i in used], [float(weights[i]) for i in used], float(bias))


def measured(docs: DataFrame, prefix: str = "_stat_") -> tuple[DataFrame, list[str]]:
    made = {prefix + n: c for n, c in statistics(F.col("text")).items()}
    return docs.withColumns(made), list(made)


def train(docs: DataFrame, labels: DataFrame, part: int = 0, parts: int = 5, sample: int = SAMPLE) -> Rules:
    """Learns from labelled documents whose crc32(doc_id as text) mod parts is not part: at most `sample`
    of them, picked by a hash of their ids. Null labels and ids are ignored; of
    several labels of one document the largest counts; documents with the same id each train."""
    ids = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_y")).dropna()
    ids = ids.filter(~held_out(F.col("_id"), part, parts)).groupBy("_id").agg(F.max("_y").alias("_y"))
    h = F.xxhash64(F.lit(11), "_id")
    ids = ids.filter(F.pmod(h, F.lit(max(1, ids.count()))) < sample).orderBy(h, "_id").limit(sample)  # the filter leaves about as many
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(ids), "_id")
    rows, names = measured(rows)
    got = rows.select("_id", "_y", *names).orderBy(F.xxhash64("_id"), *names).limit(2 * sample).collect()
    x = np.array([[r[n] for n in names] for r in got], float).reshape(-1, len(names))
    return fit(x, np.array([float(r["_y"] > 0) for r in got]), names)


def scored(docs: DataFrame, rules: Rules) -> DataFrame:
    """docs with _score. A null text is scored as an empty one."""
    rows, names = measured(docs)
    return rows.withColumn("_score", rules.score()).drop(*names)


def report(docs: DataFrame, labels: DataFrame, part: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; repeated rows are scored as often as they
    occur, other columns are ignored, and an empty table gives no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, labels, part))
    return out.select("doc_id", held_out(F.col("doc_id"), part).alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= KEEP_AT, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects. Where no rule could be fitted (one label only, too few
    labels), nothing tells documents apart, and all are kept."""
    rules = train(docs, labels)
    if not rules.rules:
        return docs
    rows = docs.select(whole_row(docs).alias("_row"), "doc_id", "text")
    return scored(rows, rules).filter(F.col("_score") >= KEEP_AT).select("_row.*")
