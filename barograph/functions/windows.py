"""Windows and null-safe expressions that the operators share.

All windows count rows. The only missing value is NULL: `clean_number` turns NaN into it once, at the
boundary, and every ratio is a try_divide, so no expression can raise or yield NaN.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from ..config import KEYS


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def over(by: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(order)


def expanding(by: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    return over(by, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def rolling(n: int, by: Sequence[str] = KEYS, order: str = "date") -> WindowSpec:
    if n < 1:
        raise ValueError("a window has at least one row")
    return over(by, order).rowsBetween(-(n - 1), Window.currentRow)


def gate(x: str | Column, result: Column, n: int, by: Sequence[str] = KEYS, order: str = "date") -> Column:
    """result where the last n rows all have x, else NULL."""
    return F.when(F.count(col(x)).over(rolling(n, by, order)) == n, result)


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def growth(now: str | Column, before: str | Column) -> Column:
    return ratio(now, before) - 1


def clean_number(x: str | Column) -> Column:
    """A double, NULL for what is not a number."""
    number = col(x).try_cast("double")
    return F.when(~F.isnan(number), number)


def paired(x: str | Column, y: str | Column) -> tuple[Column, Column]:
    """x and y where both are known."""
    both = col(x).isNotNull() & col(y).isNotNull()
    return F.when(both, col(x)), F.when(both, col(y))


def correlation(x: str | Column, y: str | Column, window: WindowSpec | None = None) -> Column:
    """Pearson's correlation of the rows where both are known; NULL without variance."""
    a, b = paired(x, y)
    parts = [F.covar_pop(a, b), F.stddev_pop(a), F.stddev_pop(b)]
    if window is not None:
        parts = [p.over(window) for p in parts]
    return F.try_divide(parts[0], parts[1] * parts[2])
