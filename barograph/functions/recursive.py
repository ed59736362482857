"""Exponentially weighted means as window sums.

y(n) = (1-a) y(n-1) + a x(n), y(0) = x(0). A series is cut into blocks so long that what lies before the
previous block weighs less than double precision can show. In a block, the recursion is a running
sum of terms scaled by powers of 1-a, which cannot overflow over one block; the previous block
enters through its last value. Long series are cut into time blocks besides (see `series`), so that an
asset is not one task. Nothing is collected and cost is linear for series of any length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import KEYS
from .series import BLOCK, carried, cut, decayed, earlier, upto
from .windows import col, expanding, over


def _inside(df: DataFrame, x: str, alpha: float, out: str, by: Sequence[str], order: str) -> DataFrame:
    """Adds out (the mean since the first known value of the partition) and {out}_i, that value's place, from 0."""
    i = f"{out}_i"
    df = df.withColumn(i, F.count(x).over(expanding(by, order)) - 1)
    keep = 1 - alpha
    if keep == 0:
        return df.withColumn(out, F.last(x, ignorenulls=True).over(expanding(by, order)))
    block = max(2, math.ceil(44 / -math.log(keep)))
    df = df.withColumn("_b", F.floor(F.col(i) / block)).withColumn("_p", F.col(i) % block)
    weight = F.when(F.col(i) == 0, 1.0).otherwise(alpha)
    inside = Window.partitionBy(*by, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_z", F.sum(F.col(x) * weight * F.pow(F.lit(keep), -F.col("_p"))).over(inside) * F.pow(F.lit(keep), F.col("_p")))
    end = F.when((F.col("_p") == block - 1) & F.col(x).isNotNull(), F.col("_z"))
    before = F.last(end, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    before = F.when(F.col("_b") > 0, before).otherwise(0.0)
    df = df.withColumn("_y", F.when(F.col(x).isNotNull(), F.col("_z") + F.pow(F.lit(keep), F.col("_p") + 1) * F.coalesce(before, F.lit(0.0))))
    return df.withColumn(out, F.last("_y", ignorenulls=True).over(expanding(by, order))).drop("_b", "_p", "_z", "_y")


def ewms(df: DataFrame, means: Sequence[tuple[str | Column, float, str, int]], by: Sequence[str] = KEYS, order: str = "date", block: str | None = BLOCK) -> DataFrame:
    """Adds weighted means, each given as (x, alpha, out, min_periods): the mean of x, NULL until min_periods values are
    known. Leading NULLs are passed over; a NULL later on repeats the mean before it. With blocks, every block's means
    start anew, and the one before a block enters with its weight; all means share one carry."""
    for k, (x, alpha, _, _) in enumerate(means):
        if not 0 < alpha <= 1:
            raise ValueError("alpha is in (0, 1]")
        df = df.withColumn(f"_x{k}", col(x).cast("double"))
    keys = list(by) if block is None else [*by, "_block"]
    df = df if block is None else cut(df, block, order)
    for k, (_, alpha, _, _) in enumerate(means):
        df = _inside(df, f"_x{k}", alpha, f"_m{k}", keys, order)
    own = [f"_{c}" for k in range(len(means)) for c in (f"x{k}", f"m{k}", f"m{k}_i")]
    if block is None:
        return df.withColumns({out: F.when(F.col(f"_m{k}_i") + 1 >= least, F.col(f"_m{k}")) for k, (_, _, out, least) in enumerate(means)}).drop(*own)
    totals = []
    for k in range(len(means)):
        known = F.when(F.col(f"_x{k}").isNotNull(), F.col(order))
        totals += [F.count(f"_x{k}").alias(f"_k{k}"), F.min_by(f"_x{k}", known).alias(f"_a{k}"), F.max_by(f"_m{k}", known).alias(f"_e{k}")]

    def carry(blocks: DataFrame) -> DataFrame:
        for k, (_, alpha, _, _) in enumerate(means):
            blocks = blocks.withColumn(f"_w{k}", F.last(f"_e{k}", ignorenulls=True).over(upto(by, "_block"))) if alpha == 1 else decayed(blocks, 1 - alpha, f"_k{k}", f"_e{k}", f"_a{k}", f"_w{k}", by)
        each = [c for k in range(len(means)) for c in (F.last(f"_w{k}", ignorenulls=True).over(earlier(by)).alias(f"_c{k}"), F.coalesce(F.sum(f"_k{k}").over(earlier(by)), F.lit(0)).alias(f"_n{k}"), F.col(f"_a{k}"))]
        return blocks.select(*keys, *each)

    met = carried(df, totals, carry, by)
    out = {}
    for k, (_, alpha, name, least) in enumerate(means):
        c, m, i, keep = F.col(f"_c{k}"), F.col(f"_m{k}"), F.col(f"_m{k}_i"), F.lit(1 - alpha)
        mean = F.when(i < 0, c).otherwise(m + F.coalesce(F.pow(keep, i + 1) * (c - F.col(f"_a{k}")), F.lit(0.0)))
        out[name] = F.when(F.col(f"_n{k}") + i + 1 >= least, mean)
    return met.withColumns(out).drop("_block", *own, *(f"_{c}{k}" for k in range(len(means)) for c in "cna"))


def ewm(df: DataFrame, x: str | Column, alpha: float, out: str, min_periods: int = 1, by: Sequence[str] = KEYS, order: str = "date", block: str | None = BLOCK) -> DataFrame:
    """Adds out, one mean of `ewms`."""
    return ewms(df, [(x, alpha, out, min_periods)], by, order, block)
