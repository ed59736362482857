"""Overview tables and short factual summaries, one row per asset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.windows import expanding, growth
from ..schema import with_label
from .clean import add_returns, price_column
from .indicators import rsi
from .regime import BEARISH, BULLISH, latest_trend, regime_now, trend_series
from .returns import at_back, numbered_back, trailing, ytd
from .volatility import numbered_returns, realized, rolling_volatility


def percent(x: str | Column, digits: int = 2, signed: bool = False) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | F.isnan(c), "—").otherwise(F.format_string(f"%{'+' if signed else ''}.{digits}f%%", c * 100))


def number(x: str | Column, digits: int = 2) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), "—").otherwise(F.format_number(c, digits))


def ratio_text(x: str | Column, digits: int = 2) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c.isNull() | F.isnan(c), "—").when(c == float("inf"), "∞").otherwise(F.format_string(f"%.{digits}f", c))


def direction(x: str | Column) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.when(c > 0, "up").when(c < 0, "down").otherwise("flat")


def with_volatility(df: DataFrame) -> DataFrame:
    return df.withColumn("vol", rolling_volatility(CONFIG.analysis.regime[2]))


def first_cards(overview: DataFrame, n: int = 3) -> DataFrame:
    """The first n assets of an overview with a dimension, in display order; assets that it lacks come last."""
    return overview.orderBy(F.col("display_order").asc_nulls_last(), "asset_key").limit(n)


def market_overview(bars: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Per asset: price, ret_1, ret_5, ret_21, ret_ytd, vol_20d, trend, regime, and the asset's name, class and
    display order if a dimension is given. One pass: all windows share the asset's exchange; after it only
    partial aggregates move."""
    p = price_column(bars)
    df = bars if "ret" in bars.columns else add_returns(bars, block=None)
    df = with_volatility(numbered_returns(numbered_back(trend_series(df, p, block=None), p)))
    out = df.groupBy("asset_key").agg(
        at_back(p, 0).alias("price"),
        *trailing(p),
        realized(CONFIG.analysis.vol_short).alias("vol_20d"),
        latest_trend(p).alias("trend"),
        regime_now().alias("regime"),
    )
    return with_label(out, dimension) if dimension is not None else out


def tape(bars: DataFrame) -> DataFrame:
    """Per asset: last price, change since the one before, direction."""
    p = price_column(bars)
    known = bars.filter(F.col(p).isNotNull()).withColumn("_back", F.row_number().over(Window.partitionBy("asset_key").orderBy(F.col("date").desc()))).filter("_back <= 2")
    out = known.groupBy("asset_key").agg(at_back(p, 0).alias("last"), growth(at_back(p, 0), at_back(p, 1)).alias("change"))
    return out.withColumn("direction", direction("change"))


def sparkline(bars: DataFrame, width: float = 260.0, height: float = 64.0) -> DataFrame:
    """asset_key, date, x, y: prices scaled to a box, high prices at the top; a constant price spans 1."""
    p = price_column(bars)
    rows = bars.filter(F.col(p).isNotNull())
    whole = Window.partitionBy("asset_key")
    span = F.max(p).over(whole) - F.min(p).over(whole)
    i, n = F.row_number().over(whole.orderBy("date")) - 1, F.count("*").over(whole)
    share = (F.col(p) - F.min(p).over(whole)) / F.when(span == 0, 1.0).otherwise(span)
    return rows.select("asset_key", "date", (i * width / F.greatest(n - 1, F.lit(1))).alias("x"), ((1 - share) * height).alias("y"))


def snapshot(bars: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """Per asset: trend, regime, rsi, ret_ytd, max_drawdown, current_drawdown, vol_20d, and observations,
    up to five sentences on them. One pass, like the overview."""
    p = price_column(bars)
    df = bars if "ret" in bars.columns else add_returns(bars, block=None)
    df = numbered_returns(numbered_back(trend_series(rsi(df, price=p, block=None), p, block=None), p))
    df = with_volatility(df.withColumn("_dd", growth(p, F.max(p).over(expanding()))))
    out = df.groupBy("asset_key").agg(
        latest_trend(p).alias("trend"),
        regime_now().alias("regime"),
        F.max_by("rsi", "date").alias("rsi"),
        ytd(p).alias("ret_ytd"),
        F.min("_dd").alias("max_drawdown"),
        F.max_by("_dd", F.when(F.col("_dd").isNotNull(), F.col("date"))).alias("current_drawdown"),
        realized(CONFIG.analysis.vol_short).alias("vol_20d"),
    )
    if dimension is not None:
        out = with_label(out, dimension)
    name = F.col("name") if dimension is not None else F.col("asset_key")
    one = lambda c, signed=False: percent(c, 1, signed)
    structure = F.when(F.col("trend") == BULLISH, "price over SMA50 over SMA200").when(F.col("trend") == BEARISH, "price under SMA50 under SMA200").otherwise("price and averages out of line")
    momentum = F.when(F.col("rsi") >= 70, "overbought").when(F.col("rsi") <= 30, "oversold").otherwise("neutral")
    deepest = F.concat(F.lit("deepest drawdown of the window "), one("max_drawdown"))
    sentences = F.array(
        F.concat(name, F.lit(": trend is "), F.lower("trend"), F.lit(" ("), structure, F.lit(").")),
        F.concat(F.lit("Volatility regime: "), F.col("regime"), F.lit("; 20-day volatility "), one("vol_20d"), F.lit(" a year.")),
        F.when(F.col("rsi").isNotNull(), F.concat(F.lit("RSI(14) at "), F.format_string("%.0f", "rsi"), F.lit(", "), momentum, F.lit("."))),
        F.when(F.col("current_drawdown") <= -0.001, F.concat(one("current_drawdown"), F.lit(" from the peak; "), deepest, F.lit("."))).when(F.col("current_drawdown").isNotNull(), F.concat(F.lit("At or near the peak; "), deepest, F.lit("."))),
        F.when(F.col("ret_ytd").isNotNull(), F.concat(one("ret_ytd", True), F.lit(" since the start of the year."))),
    )
    return out.withColumn("observations", F.array_compact(sentences))
