"""As-of joins of two tables in time order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.series import BLOCK, running


def _passed(left: DataFrame, right: DataFrame, by: Sequence[str], left_time: str, right_time: str, out: str, forward: bool, exact: bool, block: str | None) -> DataFrame:
    """left with out: the last row of right at or before its time (at or after, if forward), as a struct."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    at = lambda c: F.timestamp_micros((-1 if forward else 1) * micros(c))
    theirs, mine = F.struct(*right.columns), F.struct(*left.columns)
    first, then = (0, 1) if exact else (1, 0)  # of rows of one time
    known = right.filter(F.col(right_time).isNotNull()).select(*by, at(right_time).alias("_at"), F.lit(first).alias("_kind"), theirs.alias(out), F.lit(None).cast(left.schema).alias("_mine"))
    asked = left.select(*by, at(left_time).alias("_at"), F.lit(then).alias("_kind"), F.lit(None).cast(right.schema).alias(out), mine.alias("_mine"))
    merged = known.unionByName(asked).withColumn("_order", F.struct("_at", "_kind", out))
    met = running(merged, {out: ("last", out)}, by, "_order", block, "_at").filter(F.col("_kind") == then)
    sound = F.col(f"_mine.`{left_time}`").isNotNull()
    for c in by:
        sound = sound & F.col(c).isNotNull()
    return met.select("_mine.*", F.when(sound, F.col(out)).alias(out))


def asof(
    left: DataFrame,
    right: DataFrame,
    by: Sequence[str] = KEYS,
    left_time: str = "date",
    right_time: str = "date",
    direction: str = "backward",
    tolerance: timedelta | None = None,
    exact: bool = True,
    out: str = "match",
    block: str | None = BLOCK,
) -> DataFrame:
    """All rows of left with `out`: a struct of the row of right with equal `by` that is the last at or before the row's
    time (backward), the first at or after it (forward), or the nearest (the earlier one of two as near). It is NULL
    where there is none, none within the tolerance, or where a key or the time is unknown. exact false leaves rows of
    the very time out. Of rows of right with one time, the largest by their columns in order counts (forward: too).

    Both tables are merged in time order and the last row of right is carried on, block by block, so that neither a key
    nor a stretch of time is one task's alone, and no row meets more than its own match."""
    if direction not in ("backward", "forward", "nearest"):
        raise ValueError(f"unknown direction {direction}")
    sides = ["backward", "forward"] if direction == "nearest" else [direction]
    names = [f"_{s}" for s in sides]
    met = left
    for side, name in zip(sides, names, strict=True):
        met = _passed(met, right, by, left_time, right_time, name, side == "forward", exact, block)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = {n: F.abs(micros(left_time) - micros(f"{n}.`{right_time}`")) for n in names}
    if tolerance is not None:
        most = round(tolerance.total_seconds() * 1_000_000)
        met = met.withColumns({n: F.when(gap[n] <= most, F.col(n)) for n in names})
    best = F.col(names[0])
    if direction == "nearest":
        best = F.when(gap["_forward"] < F.coalesce(gap["_backward"], gap["_forward"] + 1), F.col("_forward")).otherwise(F.col("_backward"))
    return met.withColumn(out, best).drop(*names)
