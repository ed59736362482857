"""Windows over series of any length.

A series is cut into time blocks (a calendar unit), and windows run inside a block, so no task has more of an asset than
one block. What lies before a block reaches it in one of two ways:

* Running results (sums, products, extremes, last values, weighted means) are carried: each block is summed up in one
  row, these few rows are scanned by asset, and each block's rows take the carry of theirs.
* Sliding frames of n rows get a halo: the n-1 rows before a block are copied to it, from as many earlier blocks as
  that takes, and dropped after.

Blocks without rows do not exist and need nothing. Rows of an unknown time come before all others, in a block of their
own; assets are not NULL. block None means plain windows, one task for an asset, which suit many short series.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..config import CONFIG, KEYS
from .windows import col, over

BLOCK = CONFIG.analysis.block
#: The range of a block of an order in numbers.
NUMBERS = 1000


def block_of(time: str | Column, unit: str) -> Column:
    """The start of the calendar unit (year, quarter, month, day, hour ...) that time lies in."""
    return F.date_trunc(unit, col(time)).cast("timestamp_ntz")


def stored_block(unit: str | int) -> str:
    return f"block_{unit}"


def cut(df: DataFrame, unit: str | int, order: str = "date") -> DataFrame:
    """Adds _block. An order in numbers is cut into ranges of `unit` (of `NUMBERS`, if that is a calendar unit). A table
    that is stored by blocks of this unit (see `sources.store`) has them as a column, which is used as it is."""
    if order == "date" and stored_block(unit) in df.columns:
        return df.withColumn("_block", F.col(stored_block(unit)))
    if isinstance(df.schema[order].dataType, NumericType):
        return df.withColumn("_block", F.floor(F.col(order) / (unit if isinstance(unit, int) else NUMBERS)))
    return df.withColumn("_block", block_of(order, unit))


def upto(by: Sequence[str], order: str = "date") -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def earlier(by: Sequence[str] = KEYS) -> WindowSpec:
    """Over block rows: the blocks before."""
    return over(by, "_block").rowsBetween(Window.unboundedPreceding, -1)


def carried(local: DataFrame, totals: Sequence[Column], carry: Callable[[DataFrame], DataFrame], by: Sequence[str] = KEYS) -> DataFrame:
    """local (rows with _block) with what carry makes of its blocks' totals: a row per block, with by and _block."""
    return local.join(carry(local.groupBy(*by, "_block").agg(*totals)), [*by, "_block"], "left")


def _last_known(x: str, order: str) -> Column:
    return F.max_by(x, F.when(F.col(x).isNotNull(), F.col(order)))


#: Per kind of running result: a block's total, the carry of totals over earlier blocks, the result of carry and the part inside.
_KINDS: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (lambda x, o: F.sum(x), F.sum, lambda c, x: F.coalesce(c + x, c, x)),
    "count": (lambda x, o: F.count(x), F.sum, lambda c, x: F.coalesce(c, F.lit(0)) + x),
    "product": (lambda x, o: F.product(F.col(x)), lambda t: F.product(F.col(t)), lambda c, x: F.coalesce(c * x, c, x)),
    "max": (lambda x, o: F.max(x), F.max, lambda c, x: F.greatest(c, x)),
    "min": (lambda x, o: F.min(x), F.min, lambda c, x: F.least(c, x)),
    "last": (_last_known, lambda t: F.last(t, ignorenulls=True), lambda c, x: F.coalesce(x, c)),
    "before": (_last_known, lambda t: F.last(t, ignorenulls=True), lambda c, x: F.coalesce(x, c)),
}
_AGG = {"sum": F.sum, "count": F.count, "product": lambda x: F.product(F.col(x)), "max": F.max, "min": F.min, "last": lambda x: F.last(x, ignorenulls=True)}


def _inside(kind: str, x: str, by: Sequence[str], order: str) -> Column:
    """The running result inside a partition."""
    if kind == "lag":
        return F.lag(x).over(over(by, order))
    if kind == "before":
        return F.last(x, ignorenulls=True).over(over(by, order).rowsBetween(Window.unboundedPreceding, -1))
    return _AGG[kind](x).over(upto(by, order))


def running(df: DataFrame, wanted: dict[str, tuple[str, str | Column]], by: Sequence[str] = KEYS, order: str = "date", block: str | None = BLOCK, time: str | None = None) -> DataFrame:
    """df with running results from the first row to this one: wanted has (kind, value) by name. Kinds: sum, count,
    product, max, min, last (the last known value), before (the last known one before this row) and lag (the value one
    row before, known or not). Unknown values do not count. All results share one carry. time: the column that blocks
    are cut by, where order is not a time itself but rises with it."""
    xs = {out: f"_x_{out}" for out in wanted}
    df = df.withColumns({xs[out]: col(x) for out, (_, x) in wanted.items()})
    if block is None:
        return df.withColumns({out: _inside(kind, xs[out], by, order) for out, (kind, _) in wanted.items()}).drop(*xs.values())
    df = cut(df, block, time or order)
    keys = [*by, "_block"]
    here = {f"_in_{out}": _inside(kind, xs[out], keys, order) for out, (kind, _) in wanted.items()}
    lags = [out for out, (kind, _) in wanted.items() if kind == "lag"]
    if lags:
        here["_first"] = F.row_number().over(over(keys, order)) == 1
    total = [F.max_by(F.struct(xs[out]), order).alias(f"_t_{out}") if kind == "lag" else _KINDS[kind][0](xs[out], order).alias(f"_t_{out}") for out, (kind, _) in wanted.items()]

    def carry(blocks: DataFrame) -> DataFrame:
        made = [F.lag(f"_t_{out}").over(over(by, "_block"))[xs[out]].alias(f"_c_{out}") if kind == "lag" else _KINDS[kind][1](f"_t_{out}").over(earlier(by)).alias(f"_c_{out}") for out, (kind, _) in wanted.items()]
        return blocks.select(*keys, *made)

    met = df.withColumns(here).join(carry(df.groupBy(*keys).agg(*total)), keys, "left")
    out = {name: F.when(F.col("_first"), F.col(f"_c_{name}")).otherwise(F.col(f"_in_{name}")) if kind == "lag" else _KINDS[kind][2](F.col(f"_c_{name}"), F.col(f"_in_{name}")) for name, (kind, _) in wanted.items()}
    return met.withColumns(out).drop("_block", *xs.values(), *here, *(f"_c_{name}" for name in wanted))


def with_halo(df: DataFrame, rows: int, by: Sequence[str] = KEYS, order: str = "date", block: str = "year") -> DataFrame:
    """df with _block and _halo, and for each block copies (_halo true, _block the later one) of the `rows` rows before it,
    fewer where the series begins. Which earlier blocks they lie in is told by the blocks' counts."""
    df = cut(df, block, order)
    own = df.withColumn("_halo", F.lit(False))
    if rows < 1:
        return own
    keys = [*by, "_block"]
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    counts = counts.withColumn("_start", F.coalesce(F.sum("_rows").over(earlier(by)), F.lit(0)))
    at = Window.partitionBy(*by).orderBy("_start")
    near = F.collect_list(F.struct("_block", "_start", "_rows")).over(at.rangeBetween(-rows, -1))  # at most `rows` blocks
    far = F.last(F.struct("_block", "_start", "_rows")).over(at.rangeBetween(Window.unboundedPreceding, -rows - 1))
    counts = counts.withColumns({"_near": near, "_far": far})
    halo = counts.select(*by, F.col("_block").alias("_to"), F.col("_start").alias("_at"), F.explode(F.array_compact(F.concat("_near", F.array("_far")))).alias("_s"))
    halo = halo.select(*by, F.col("_s._block").alias("_block"), "_to", (F.col("_at") - F.col("_s._start") - F.col("_s._rows")).alias("_gap")).filter(F.col("_gap") < rows)
    back = df.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc()))).filter(F.col("_back") <= rows)
    copies = back.join(halo, keys).filter(F.col("_back") + F.col("_gap") <= rows)
    copies = copies.select(*df.drop("_block").columns, F.col("_to").alias("_block"), F.lit(True).alias("_halo"))
    return own.unionByName(copies)


def framed(df: DataFrame, rows: int, build: Callable[[DataFrame, list[str]], DataFrame], by: Sequence[str] = KEYS, order: str = "date", block: str | None = BLOCK) -> DataFrame:
    """build(df, by) where its windows look at most `rows` rows back: with blocks, by also has the block, and build sees
    the block's rows after their halo."""
    if block is None:
        return build(df, list(by))
    return build(with_halo(df, rows, by, order, block), [*by, "_block"]).filter(~F.col("_halo")).drop("_block", "_halo")


def decayed(blocks: DataFrame, keep: float, count: str, end: str, first: str, out: str, by: Sequence[str] = KEYS) -> DataFrame:
    """Adds out: the weighted mean at the end of each block, from the means that start anew in each (end), the blocks' first
    values and counts of known values. A mean m before a block of k values with the first value x changes its end by
    keep^k (m - x); these terms are summed over blocks of blocks that hold what double precision can show."""
    size = max(2, math.ceil(44 / -math.log(keep)))
    k = F.col(count)
    powered = lambda n: F.pow(F.lit(keep), n)
    df = blocks.withColumn("_upto", F.sum(k).over(upto(by, "_block")) - 1)
    term = F.when(k > 0, F.when(F.col("_upto") + 1 == k, F.col(end)).otherwise(F.col(end) - powered(k) * F.col(first)))
    df = df.withColumns({"_term": term, "_group": F.floor(F.col("_upto") / size), "_p": F.col("_upto") % size})
    inside = F.sum(F.col("_term") * powered(-F.col("_p"))).over(upto([*by, "_group"], "_block")) * powered(F.col("_p"))
    df = df.withColumn("_near", inside)
    before = F.max(F.struct("_upto", "_near")).over(over(by, "_group").rangeBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_before", before)
    far = F.coalesce(F.col("_before._near") * powered(F.col("_upto") - F.col("_before._upto")), F.lit(0.0))
    return df.withColumn(out, F.when(F.col("_upto") >= 0, F.col("_near") + far)).drop("_upto", "_term", "_group", "_p", "_near", "_before")
