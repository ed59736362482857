"""Exact top-k inner products with a pivot-distance index.

Inner products become distances by one more coordinate: a vector x gets sqrt(M^2 - |x|^2), M being the
longest vector's length, a query gets 0; then |q - x|^2 = |q|^2 + M^2 - 2 q.x. Vectors are keyed by their nearest
pivot and their distance to it; equal steps of distance cut each pivot's cell into annuli. Of an annulus the
least and greatest distances to every pivot are kept, and its longest vector. By the triangle inequality none of
its vectors is nearer to a query than the gap between these distances and the query's own to that pivot; the largest
gap counts, or what |q| |x| allows. A query takes annuli from the nearest outwards, in three waves, and is done when
the bound passes its k-th best.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Fixed sizes of the index: pivots, annuli a cell, rows a block of candidates or of queries.
PIVOTS, ANNULI, BLOCK = 24, 8, 2048
#: The score of a vector with itself, which never counts.
OWN = -(2**63) + 1


def integral(vectors: DataFrame, factor: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v: every component as floor(factor * component). Null vectors and those with null or
    non-finite components take no part; empty vectors do, their products are 0."""
    v = F.col(vec_col).cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter(sound).select("id", F.transform("v", lambda x: F.floor(x * factor).cast("long")).alias("v"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists as the rows of a matrix; shorter ones are filled up with zeros, which change no product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(lists), dim), np.int64)
    n = np.diff(offsets)
    if len(n) and (n == dim).all():
        return flat[offsets[0] : offsets[-1]].reshape(-1, dim)
    rows = np.repeat(np.arange(len(n)), n)
    out[rows, np.arange(len(rows)) - np.repeat(offsets[:-1] - offsets[0], n)] = flat[offsets[0] : offsets[-1]]
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where all sums stay below 2^53."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    return np.rint(q.astype(float) @ x.T.astype(float)).astype(np.int64) if most < 2**53 else q @ x.T


def lists(values: np.ndarray, column: pa.Array) -> pa.ListArray:
    """A list a row of the matrix values; column holds its cells, row after row."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), column)


@dataclass(frozen=True)
class Annuli:
    """What is known of the annuli: rows of lo, hi (distances to every pivot), norm (the longest vector), cell, n."""

    pivots: np.ndarray
    longest: float
    lo: np.ndarray
    hi: np.ndarray
    norm: np.ndarray
    cell: np.ndarray
    n: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query and annulus: no vector is nearer than this; and the distance to the annulus's pivot."""
        own = (q * q).sum(1)
        d = np.sqrt(np.maximum(0.0, own[:, None] + (self.pivots**2).sum(1) - 2 * q @ self.pivots[:, :-1].T))
        least = np.sqrt(np.maximum(0.0, own[:, None] + self.longest**2 - 2 * np.sqrt(own)[:, None] * self.norm))
        for p in range(d.shape[1]):
            np.maximum(least, np.maximum(d[:, p, None] - self.hi[:, p], self.lo[:, p] - d[:, p, None]), out=least)
        slack = 1e-6 * (self.longest + np.sqrt(own)) + 1e-9  # rounding of the distances
        return least - slack[:, None], d[:, self.cell]

    def waves(self, order: np.ndarray, first: int) -> np.ndarray:
        """The wave of each place of order: 0 up to `first` vectors, 1 up to an eighth of all, 2."""
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        return (before >= first).astype(np.int32) + (before >= max(first, self.n.sum() // 8))


def keys(vectors: DataFrame, pivots: np.ndarray, longest: float) -> DataFrame:
    """Adds cell (the nearest pivot), far (the distance to it), dist (those to all) and norm to id, tag, first, v."""
    dim = pivots.shape[1] - 1

    def run(batches):
        for batch in batches:
            x = matrix(batch.column("v"), dim).astype(float)
            square = (x * x).sum(1)
            x = np.hstack([x, np.sqrt(np.maximum(0.0, longest**2 - square))[:, None]])
            d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * x @ pivots.T))
            cell = d.argmin(1)
            made = [pa.array(cell.astype(np.int32)), pa.array(d[np.arange(len(cell)), cell]), lists(d, pa.array(d.astype(np.float32).ravel())), pa.array(np.sqrt(square))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "cell", "far", "dist", "norm"])

    return vectors.mapInArrow(run, "id long, tag long, first boolean, v array<long>, cell int, far double, dist array<float>, norm double")


def planned(queries: DataFrame, annuli: Annuli, first: int) -> DataFrame:
    """query, asked, qv, near (the nearest pivot) and visits: every annulus with its bound and wave. Written once, as
    sums of floats may differ with the batch and all waves must go by one order."""
    dim = annuli.pivots.shape[1] - 1

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                rows = batch.slice(a, 1024)
                bound, d = annuli.bounds(matrix(rows.column("v"), dim).astype(float))
                order = np.argsort(bound + 1e-3 * d, axis=1, kind="stable")
                wave = annuli.waves(order, first)
                fields = {"shell": order.astype(np.int32), "bound": np.take_along_axis(bound, order, 1), "wave": wave}
                visits = pa.StructArray.from_arrays([pa.array(c.ravel()) for c in fields.values()], names=list(fields))
                near = annuli.cell[d.argmin(1)].astype(np.int32)
                yield pa.RecordBatch.from_arrays([rows.column("id"), rows.column("tag"), rows.column("v"), pa.array(near), lists(order, visits)], names=["query", "asked", "qv", "near", "visits"])

    schema = "query long, asked long, qv array<long>, near int, visits array<struct<shell: int, bound: double, wave: int>>"
    return materialize(queries.select("id", "tag", "v").mapInArrow(run, schema), "plan")


def scan(pairs: DataFrame, blocks: DataFrame, k: int, dim: int) -> DataFrame:
    """query, asked, id, score: of every (query, block) pair the block's k best, a query's own row left out. pairs: query,
    asked, qv, shell, block, part; blocks: the candidates with the same keys. Pairs and candidates meet in groups of at
    most about BLOCK queries by BLOCK candidates."""
    names = ["query", "asked", "id", "score"]

    def run(key, left, right):
        left, right = left.sort_by([("query", "ascending"), ("asked", "ascending")]), right.sort_by("id")
        if not left.num_rows or not right.num_rows:
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        q_ids, asked = left["query"].to_numpy(), left["asked"].to_numpy()
        x_ids, tags, x = right["id"].to_numpy(), right["tag"].to_numpy(), matrix(right["v"], dim)
        one = right["first"].to_numpy()
        out = []
        for a in range(0, len(q_ids), 512):
            b = slice(a, a + 512)
            s = products(matrix(left["qv"].slice(a, 512), dim), x)
            i, j = np.nonzero(q_ids[b, None] == x_ids[None, :])
            own = (asked[b][i] == tags[j]) & one[j]
            s[i[own], j[own]] = OWN
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(s, top, 1)
            sound = best > OWN
            out.append((np.broadcast_to(q_ids[b, None], top.shape)[sound], np.broadcast_to(asked[b, None], top.shape)[sound], x_ids[top][sound], best[sound]))
        return pa.table({n: np.concatenate(c) for n, c in zip(names, zip(*out, strict=True), strict=True)})

    on = ["shell", "block", "part"]
    blocks = blocks.select("id", "tag", "first", "v", *[F.col(c).alias(c) for c in on])  # columns apart from those of pairs
    return pairs.groupBy(*on).cogroup(blocks.groupBy(*on)).applyInArrow(run, ", ".join(f"{n} long" for n in names))


def best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query", "asked").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def topk(vectors: DataFrame, queries: DataFrame, k: int = 5, n_pivots: int = PIVOTS, annuli: int = ANNULI) -> DataFrame:
    """query, rank, id, score: the k largest inner products of each query with all rows of vectors but its
    own (one row of its id and its vector), ties to the smaller id. vectors and queries: id, v (array of longs).

    Fewer candidates give fewer rows; vectors of different lengths are compared as if filled up
    with zeros; empty tables give no rows. Rows without id or vector take no part. Rows that share an id count each
    with its own vector, and repeated rows as often as they are there; queries equal in id and vector are asked once,
    and those of one id have a list each. Other columns are ignored. Only the pivots
    (n_pivots vectors, the farthest-first choice from at most 2000 that a hash of the ids picks) and
    n_pivots * annuli rows of n_pivots distances reach the driver.
    """
    spark = vectors.sparkSession
    tagged = [F.col("id").cast("long").alias("id"), F.xxhash64("v").alias("tag"), "v"]
    queries = queries.filter("id is not null and v is not null").select(*tagged).distinct()
    # no query needs more than k copies of a row, and its own
    counted = vectors.filter("id is not null and v is not null").select(*tagged).groupBy("id", "tag", "v").agg(F.least(F.count("*"), F.lit(k + 1)).alias("_copies"))
    vectors = counted.select("id", "tag", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_copy"), "v")
    vectors = materialize(vectors.select("id", "tag", (F.col("_copy") == 1).alias("first"), "v"), "vectors")
    schema = "query long, rank int, id long, score long"
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = vectors.agg(F.max(F.size("v")), F.max(square), F.count("*")).first()
    if size[0] is None:
        return spark.createDataFrame([], schema)
    dim = max(1, size[0], queries.agg(F.max(F.size("v"))).first()[0] or 0)
    longest = float(np.sqrt(size[1]))
    few = vectors.filter(F.pmod(F.xxhash64("id", "tag"), F.lit(size[2])) < 2000)
    rows = [r["v"] for r in few.orderBy(F.xxhash64("id", "tag"), "id").limit(2000).select("v").collect()]
    rows = rows or [vectors.first()["v"]]
    sample = np.array([list(v) + [0] * (dim - len(v)) for v in rows], float)
    sample = np.hstack([sample, np.sqrt(np.maximum(0.0, longest**2 - (sample**2).sum(1)))[:, None]])
    chosen, gap = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n_pivots, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]

    indexed = materialize(keys(vectors, pivots, longest), "annuli")
    step = indexed.agg(F.max("far")).first()[0] / annuli or 1.0
    ring = F.least(F.floor(F.col("far") / step), F.lit(annuli - 1)).cast("int")
    shell_of = (F.col("cell") * annuli + ring).alias("_shell")
    ends = [f(F.col("dist")[p]).alias(f"{n}{p}") for n, f in (("lo", F.min), ("hi", F.max)) for p in range(len(pivots))]
    rings = indexed.groupBy(shell_of).agg(F.count("*").alias("n"), F.max("norm").alias("norm"), *ends).orderBy("_shell").collect()
    column = lambda name: np.array([r[name] for r in rings])
    of_pivots = lambda name: np.array([[r[f"{name}{p}"] for p in range(len(pivots))] for r in rings], float)
    known = Annuli(pivots, longest, of_pivots("lo"), of_pivots("hi"), column("norm"), column("_shell") // annuli, column("n"))
    shells = spark.createDataFrame([(r["_shell"], i, -(-r["n"] // BLOCK)) for i, r in enumerate(rings)], "_shell int, shell int, blocks int")
    place = F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")
    placed = indexed.withColumn("_shell", shell_of).join(F.broadcast(shells), "_shell").select("id", "tag", "first", "v", "shell", place.alias("block"))

    # queries near one pivot share parts, so that a part visits few annuli
    plan = planned(queries, known, 4 * k + 64)
    starts, start = [], 0
    for r in plan.groupBy("near").count().orderBy("near").collect():
        starts.append((r["near"], start, r["count"]))
        start += r["count"]
    if not starts:
        return spark.createDataFrame([], schema)
    starts = spark.createDataFrame(starts, "near int, start long, of long")
    part = F.floor((F.col("start") + F.pmod(F.xxhash64("query", "asked"), F.col("of"))) / BLOCK).cast("int")
    plan = plan.join(F.broadcast(starts), "near").select("query", "asked", "qv", "visits", part.alias("part"))
    own = F.aggregate("qv", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))

    def wave(number: int, seen: DataFrame | None) -> DataFrame:
        """The k best of the annuli of this wave that a query's k-th best so far leaves open, and of those seen."""
        asked = plan.withColumn("reach", F.lit(None).cast("double"))
        if seen is not None:
            least = seen.groupBy("query", "asked").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
            reach = F.sqrt(F.greatest(F.lit(0.0), own + F.lit(longest**2) - 2 * F.col("least")))
            asked = plan.join(least, ["query", "asked"], "left").withColumn("reach", reach)
        visits = F.filter("visits", lambda v: (v["wave"] == number) & (F.col("reach").isNull() | (v["bound"] <= F.col("reach"))))
        asked = asked.select("query", "asked", "qv", "part", F.explode(F.transform(visits, lambda v: v["shell"])).alias("shell"))
        wanted = asked.select("shell", "part").distinct()
        blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
        pairs = asked.join(F.broadcast(shells), "shell").select("query", "asked", "qv", "part", "shell", blocks)
        found = scan(pairs, placed.join(wanted, "shell"), k, dim)
        return best(found if seen is None else found.union(seen), k).select("query", "asked", "id", "score", "rank")

    seen = None
    for number in (0, 1):
        seen = materialize(wave(number, seen).drop("rank"), "wave")
    return wave(2, seen).select("query", F.col("rank").cast("int").alias("rank"), "id", "score")
