"""Technical indicators over bars of many assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIG, KEYS
from ..functions.recursive import ewm, ewms
from ..functions.series import BLOCK, framed, running
from ..functions.windows import col, gate, ratio, rolling

A = CONFIG.analysis


def sma(window: int, price: str = "adj_close", by: Sequence[str] = KEYS) -> Column:
    return gate(price, F.avg(price).over(rolling(window, by)), window, by)


def ema(df: DataFrame, span: int, price: str = "adj_close", out: str = "ema", min_periods: int | None = None, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    return ewm(df, price, 2.0 / (span + 1), out, span if min_periods is None else min_periods, by, block=block)


def with_sma(df: DataFrame, windows: dict[str, int], price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds simple averages, given as windows by name."""
    return framed(df, max(windows.values()) - 1, lambda d, keys: d.withColumns({out: sma(n, price, keys) for out, n in windows.items()}), by, block=block)


def moving_averages(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds sma_20, sma_50, sma_200, ema_20, ema_50."""
    df = with_sma(df, {f"sma_{n}": n for n in A.sma}, price, by, block)
    return ewms(df, [(price, 2.0 / (n + 1), f"ema_{n}", n) for n in A.ema], by, block=block)


def rsi(df: DataFrame, period: int | None = None, price: str = "adj_close", out: str = "rsi", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Wilder's index: 100 without losses, 50 without moves, NULL in the first `period` rows."""
    n = period or A.rsi
    df = running(df, {"_before": ("lag", price)}, by, block=block)
    df = df.withColumn("_m", F.col(price) - F.col("_before")).drop("_before")
    df = df.withColumns({"_up": F.when(F.col("_m").isNotNull(), F.greatest("_m", F.lit(0.0))), "_down": F.when(F.col("_m").isNotNull(), F.greatest(-F.col("_m"), F.lit(0.0)))})
    df = ewms(df, [("_up", 1.0 / n, "_gain", n), ("_down", 1.0 / n, "_loss", n)], by, block=block)
    g, d = F.col("_gain"), F.col("_loss")
    value = F.when((g == 0) & (d == 0), 50.0).when(d == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + ratio(g, d)))
    return df.withColumn(out, value).drop("_m", "_up", "_down", "_gain", "_loss")


def macd(df: DataFrame, fast: int | None = None, slow: int | None = None, signal: int | None = None, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds macd, macd_signal, macd_histogram, all known from the first price on."""
    f, s, g = fast or A.macd[0], slow or A.macd[1], signal or A.macd[2]
    df = ewms(df, [(price, 2.0 / (f + 1), "_f", 1), (price, 2.0 / (s + 1), "_s", 1)], by, block=block).withColumn("macd", F.col("_f") - F.col("_s"))
    df = ema(df, g, "macd", "macd_signal", 1, by, block)
    return df.withColumn("macd_histogram", F.col("macd") - F.col("macd_signal")).drop("_f", "_s")


def bollinger(df: DataFrame, window: int | None = None, width: float | None = None, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds bb_middle, bb_upper, bb_lower, bb_width; the deviation is the population's."""
    n, k = window or A.bollinger[0], A.bollinger[1] if width is None else width
    bands = lambda d, keys: d.withColumns({"bb_middle": sma(n, price, keys), "_sd": gate(price, F.stddev_pop(price).over(rolling(n, keys)), n, keys)})
    df = framed(df, n - 1, bands, by, block=block)
    df = df.withColumns({"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")})
    return df.withColumn("bb_width", ratio(F.col("bb_upper") - F.col("bb_lower"), "bb_middle")).drop("_sd")


def true_range(before: str | Column) -> Column:
    """The largest of high-low and the distances of both to the previous close; unknown ones do not count."""
    before = col(before)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def atr(df: DataFrame, period: int | None = None, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds true_range and atr (Wilder's mean of it)."""
    n = period or A.atr
    df = running(df, {"_before": ("lag", "close")}, by, block=block).withColumn("true_range", true_range("_before")).drop("_before")
    return ewm(df, "true_range", 1.0 / n, "atr", n, by, block=block)
