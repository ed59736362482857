"""Volatility of returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, KEYS
from ..functions.series import BLOCK, framed
from ..functions.windows import gate, rolling

TD = CONFIG.analysis.trading_days


def rolling_volatility(window: int, ret: str = "ret", annualize: bool = True, td: int = TD, by: Sequence[str] = KEYS) -> Column:
    """Sample deviation of the last `window` returns, NULL unless all are known."""
    sd = F.stddev_samp(ret).over(rolling(window, by)) * (td**0.5 if annualize else 1.0)
    return gate(ret, sd, window, by)


def annualized(ret: str = "ret", td: int = TD) -> Column:
    """Aggregate: sample deviation of all known returns per year."""
    return F.stddev_samp(ret) * td**0.5


def annualized_volatility(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS, td: int = TD) -> DataFrame:
    return df.groupBy(*by).agg(annualized(ret, td).alias("vol"))


def numbered_returns(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS) -> DataFrame:
    """Adds _ret_back, the place from the end among known returns, which come first."""
    return df.withColumn("_ret_back", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ret).isNull(), F.col("date").desc())))


def realized(window: int, ret: str = "ret", td: int = TD) -> Column:
    """Aggregate over numbered returns: the annual deviation of the last `window` known ones, NULL if fewer."""
    newest = F.when(F.col("_ret_back") <= window, F.col(ret))
    return F.when(F.count(newest) == window, F.stddev_samp(newest) * td**0.5)


def realized_volatility(df: DataFrame, window: int, ret: str = "ret", by: Sequence[str] = KEYS, td: int = TD) -> DataFrame:
    """vol of the last `window` known returns of each asset."""
    return numbered_returns(df, ret, by).groupBy(*by).agg(realized(window, ret, td).alias("vol"))


def with_volatility(df: DataFrame, windows: dict[str, int], ret: str = "ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds rolling volatilities, given as windows by name."""
    return framed(df, max(windows.values()) - 1, lambda d, keys: d.withColumns({out: rolling_volatility(n, ret, by=keys) for out, n in windows.items()}), by, block=block)


def volatility_frame(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds vol_20d and vol_60d."""
    a = CONFIG.analysis
    return with_volatility(df, {f"vol_{n}d": n for n in (a.vol_short, a.vol_long)}, ret, by, block)
