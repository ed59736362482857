"""Drawdowns from the running peak."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import KEYS
from ..functions.series import BLOCK, carried, cut, earlier, running, upto
from ..functions.windows import expanding, growth


def drawdown_series(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Known prices with their running peak and drawdown."""
    df = running(df.filter(F.col(price).isNotNull()), {"peak": ("max", price)}, by, block=block)
    return df.withColumn("drawdown", growth(price, "peak"))


def drawdown_from_returns(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """equity, peak and drawdown of compounded returns; the peak starts at the first equity, not at 1. A block's own
    products, their extremes and the factor from before it make its equities and its peaks, so one carry does."""
    df = df.withColumn("_f", 1 + F.coalesce(F.col(ret), F.lit(0.0)))
    if block is None:
        df = df.withColumn("equity", F.product(F.col("_f")).over(expanding(by))).withColumn("peak", F.max("equity").over(expanding(by)))
        return df.withColumn("drawdown", growth("equity", "peak")).drop("_f")
    keys = [*by, "_block"]
    df = cut(df, block).withColumn("_e", F.product(F.col("_f")).over(upto(keys)))
    df = df.withColumns({"_high": F.max("_e").over(upto(keys)), "_low": F.min("_e").over(upto(keys))})

    def carry(blocks: DataFrame) -> DataFrame:
        blocks = blocks.withColumn("_c", F.coalesce(F.product(F.col("_p")).over(earlier(by)), F.lit(1.0)))
        return blocks.select(*keys, "_c", F.max(F.greatest(F.col("_c") * F.col("_h"), F.col("_c") * F.col("_l"))).over(earlier(by)).alias("_peak"))

    df = carried(df, [F.max_by("_e", "date").alias("_p"), F.max("_e").alias("_h"), F.min("_e").alias("_l")], carry, by)
    peak = F.greatest("_peak", F.when(F.col("_c") >= 0, F.col("_c") * F.col("_high")).otherwise(F.col("_c") * F.col("_low")))
    df = df.withColumns({"equity": F.col("_c") * F.col("_e"), "peak": peak})
    return df.withColumn("drawdown", growth("equity", "peak")).drop("_f", "_block", "_e", "_high", "_low", "_c", "_peak")


def max_drawdown(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    return drawdown_series(df, price, by, block).groupBy(*by).agg(F.min("drawdown").alias("max_drawdown"))


def max_drawdown_stats(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Per asset: max_drawdown, current_drawdown, peak_date (the first of the highest price up to the
    trough), trough_date (the first of the deepest drawdown), recovery_date (the first day from the trough on at
    the peak price again, NULL if none) and recovered."""
    known = df.filter(F.col(price).isNotNull())
    dated = F.struct(F.col(price).alias("price"), (-F.unix_micros(F.col("date").cast("timestamp"))).alias("age"), F.col("date").alias("date"))
    dd = running(known, {"_top": ("max", dated)}, by, block=block).withColumn("drawdown", growth(price, "_top.price"))
    deepest = dd.groupBy(*by).agg(
        F.min(F.struct("drawdown", "date", "_top")).alias("_t"),
        F.max_by("drawdown", "date").alias("current_drawdown"),
    )
    out = deepest.select(*by, F.col("_t.drawdown").alias("max_drawdown"), "current_drawdown", F.col("_t._top.date").alias("peak_date"), F.col("_t.date").alias("trough_date"), F.col("_t._top.price").alias("_high"))
    again = known.select(*by, "date", price).join(out.select(*by, "trough_date", "_high"), list(by))
    again = again.filter((F.col("date") >= F.col("trough_date")) & (F.col(price) >= F.col("_high"))).groupBy(*by).agg(F.min("date").alias("recovery_date"))
    return out.join(again, list(by), "left").withColumn("recovered", F.col("recovery_date").isNotNull()).drop("_high")
