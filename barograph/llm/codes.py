"""Product quantisation of vectors by Lloyd's method with Hamerly's bounds, in integers.

Vectors of floor(1024 x) are cut into equal consecutive parts; each part position has a codebook, improved by rounds
of assignment to the nearest entry (ties to the lower index) and replacement by the floored mean. Every part keeps its
entry, an upper bound of the distance to it and a lower bound of the distance to the second nearest. When entries
move, the upper bound grows by its entry's move and the lower one shrinks by the largest move of the others; while
the upper bound is strictly below the lower one, the entry is the only nearest and nothing is compared. Otherwise the
distance to the own entry is taken anew, and if that does not settle it, all entries are scanned in exact integers.

The parts and their bounds are a table that every round rewrites without a shuffle; codebooks and their sums, a fixed
number of integers whatever the table's size, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, stored
from .topk import lists, matrix

PARTS, ENTRIES, ROUNDS, FACTOR = 4, 256, 4, 1024.0
#: Components (as integers) beyond this count as this: squares of parts of up to 2048 components then fit 64 bits.
MOST = 1 << 25
#: More than the rounding of a square root and of a sum of such.
_UP, _DOWN = 1 + 2.0**-40, 1 - 2.0**-40
_STATE = "vec_id long, label int, v array<long>, code array<int>, upper array<double>, lower array<double>"


def integers(vectors: DataFrame, factor: float = FACTOR) -> DataFrame:
    """vec_id, label, v: components as floor(factor * component). Null vectors and those with null or non-finite
    components go; values beyond `MOST` count as it."""
    v = F.col("embedding").cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(v, lambda x: F.greatest(F.least(F.floor(x * factor), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.when(sound, whole).alias("v")).filter("v is not null")


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of x to those of c: in doubles where everything stays below 2^53."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if 4 * most * most * max(1, x.shape[1]) < 2**53:
        x, c = x.astype(float), c.astype(float)
        return np.rint((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)).astype(np.int64)
    return (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * (x @ c.T)


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of x: the nearest row of c (the lower of equals), an upper bound of its distance, a lower bound of
    the next one's."""
    d = squares(x, c)
    code, at = d.argmin(1), np.arange(len(x))
    own = np.sqrt(d[at, code]) * _UP
    if len(c) == 1:
        return code, own, np.full(len(x), np.inf)
    d[at, code] = np.iinfo(np.int64).max
    return code, own, np.sqrt(d.min(1)) * _DOWN


@dataclass(frozen=True)
class Moves:
    """How far each entry of a part's codebook has moved at most, and the largest move but its own."""

    own: np.ndarray
    others: np.ndarray

    @staticmethod
    def between(before: np.ndarray, after: np.ndarray) -> Moves:
        own = np.sqrt(((after - before) ** 2).sum(1)) * _UP
        top = np.argsort(own)[::-1]
        others = np.full(len(own), own[top[0]])
        others[top[0]] = own[top[1]] if len(own) > 1 else 0.0
        return Moves(own, others)


def assigned(x: np.ndarray, book: np.ndarray, moves: Moves | None, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The new code, upper and lower of a part, and how many rows were scanned. Without moves all are."""
    if moves is None:
        return *nearest(x, book), len(x)
    upper, lower, code = (upper + moves.own[code]) * _UP, (lower - moves.others[code]) * _DOWN, code.copy()
    open_ = np.flatnonzero(~(upper < lower))
    upper[open_] = np.sqrt(((x[open_] - book[code[open_]]) ** 2).sum(1)) * _UP
    open_ = open_[~(upper[open_] < lower[open_])]
    if len(open_):
        code[open_], upper[open_], lower[open_] = nearest(x[open_], book)
    return code, upper, lower, len(open_)


def _cells(column: pa.Array, n: int, like: type) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), like).reshape(-1, n)


def assign(state: DataFrame, books: np.ndarray, before: np.ndarray | None = None) -> DataFrame:
    """state (`_STATE` columns) with code, upper and lower for these codebooks (part, entry, component); before: the
    codebooks that its bounds are for, if it has any."""
    parts, _, width = books.shape
    moves = [None if before is None else Moves.between(before[p], books[p]) for p in range(parts)]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"), parts * width)
            if before is None:
                made = (np.zeros((len(x), parts), np.int64), np.zeros((len(x), parts)), np.zeros((len(x), parts)))
            else:
                made = (_cells(batch.column("code"), parts, np.int64).copy(), _cells(batch.column("upper"), parts, float).copy(), _cells(batch.column("lower"), parts, float).copy())
            for p in range(parts):
                got = assigned(x[:, p * width : (p + 1) * width], books[p], moves[p], *(m[:, p] for m in made))
                for m, g in zip(made, got[:3], strict=True):
                    m[:, p] = g
            new = [lists(made[0], pa.array(made[0].ravel().astype(np.int32))), lists(made[1], pa.array(made[1].ravel())), lists(made[2], pa.array(made[2].ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("vec_id", "label", "v")] + new, names=["vec_id", "label", "v", "code", "upper", "lower"])

    return state.mapInArrow(run, _STATE)


def sums(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts (part, entry) and sums (part, entry, component) of an assigned state: each task adds up what it reads,
    then rows meet by part and entry; their number is that of the codebooks' integers."""
    parts, entries, width = books.shape

    def run(batches):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if batch.num_rows:
                x, code = matrix(batch.column("v"), parts * width), _cells(batch.column("code"), parts, np.int64)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], x[:, p * width : (p + 1) * width])
                    count[p] += np.bincount(code[:, p], minlength=entries)
        p, e = np.nonzero(count)
        flat = np.hstack([count[p, e][:, None], total[p, e]])
        yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), lists(flat, pa.array(flat.ravel()))], names=["p", "e", "s"])

    partial = state.select("v", "code").mapInArrow(run, "p int, e int, s array<long>")
    each = [F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(width + 1)]
    count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for row in partial.groupBy("p", "e").agg(*each).collect():  # parts * entries rows at most
        count[row[0], row[1]], total[row[0], row[1]] = row[2], row[3:]
    return count, total


@dataclass(frozen=True)
class Quantised:
    """rows (vec_id, label, v, code, upper, lower), stored; the codebooks (part, entry, component)."""

    rows: DataFrame
    books: np.ndarray


def train(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Quantised:
    """Codebooks and codes of all vectors of `integers`.

    The first codebooks are the parts of the vectors with the smallest vec_ids (nulls last, equal ids by vector), fewer
    where there are fewer vectors. Vectors shorter than the longest count as filled up with zeros, and so does a
    length that `parts` does not divide. An empty table gives no rows and empty codebooks."""
    spark = vectors.sparkSession
    empty = [F.array().cast(f"array<{t}>").alias(c) for c, t in (("code", "int"), ("upper", "double"), ("lower", "double"))]
    state, path = stored(vectors.select("vec_id", "label", "v", *empty), "vectors")
    dim = state.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-dim // parts))
    first = state.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for e, (v,) in enumerate(first):
        books[:, e] = np.pad(np.asarray(v, np.int64), (0, parts * width - len(v))).reshape(parts, width)
    if not first:
        return Quantised(state, books)
    before = None
    for k in range(rounds + 1):
        made, made_path = stored(assign(state, books, before), "coded")
        remove(spark, path)
        state, path = made, made_path
        if k < rounds:
            count, total = sums(state, books)
            used = count > 0
            before, books = books, np.where(used[:, :, None], np.floor_divide(total, np.maximum(count, 1)[:, :, None]), books)
    return Quantised(state, books)


def reconstruct(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id and the integers that each code stands for."""

    def run(batches):
        for batch in batches:
            code = _cells(batch.column("code"), len(books), np.int64)
            out = np.hstack([books[p][code[:, p]] for p in range(len(books))]) if batch.num_rows else np.zeros((0, 1), np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), lists(out, pa.array(out.ravel()))], names=["vec_id", "v"])

    return rows.select("vec_id", "code").mapInArrow(run, "vec_id long, v array<long>")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def errors(made: Quantised) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error: the exact squared distance of each vector to its entries."""
    books = made.books
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = matrix(batch.column("v"), parts * width), _cells(batch.column("code"), parts, np.int64)
            off = sum(((x[:, p * width : (p + 1) * width] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            text = ["".join(f"{c:02x}" for c in row) for row in code.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(off)], names=["vec_id", "label", "code", "error"])

    return made.rows.select("vec_id", "label", "v", "code").mapInArrow(run, "vec_id long, label int, code string, error long")


def report(vectors: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (summed over equal labels, nulls together), codebooks_sha256; see `train`.
    Repeated rows count as often as they occur; other columns than vec_id, embedding and label are ignored."""
    made = train(integers(vectors))
    rows = materialize(errors(made), "errors")
    by = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    met = rows.join(by, rows["label"].eqNullSafe(by["_label"]))
    return met.select("vec_id", "code", "error", "label_error", F.lit(digest(made.books)).alias("codebooks_sha256"))
