"""Returns and growth rates. Every function takes a table with asset_key, date and a price or return."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, KEYS
from ..functions.series import BLOCK, running
from ..functions.windows import growth

TD = CONFIG.analysis.trading_days


def daily_returns(df: DataFrame, price: str = "adj_close", out: str = "ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    return running(df, {"_before": ("lag", price)}, by, block=block).withColumn(out, growth(price, "_before")).drop("_before")


def cumulative_returns(df: DataFrame, ret: str = "ret", out: str = "cum_ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Compounded since the start; an unknown return counts as 0."""
    return running(df, {out: ("product", 1 + F.coalesce(F.col(ret), F.lit(0.0)))}, by, block=block).withColumn(out, F.col(out) - 1)


def numbered_back(df: DataFrame, price: str, by: Sequence[str] = KEYS) -> DataFrame:
    """Adds _back, the place from the end (from 1) among rows with a known price, which come first, and
    _last, the date of the last of them."""
    whole = Window.partitionBy(*by)
    back = F.row_number().over(whole.orderBy(F.col(price).isNull(), F.col("date").desc()))
    return df.withColumns({"_back": back, "_last": F.max(F.when(F.col(price).isNotNull(), F.col("date"))).over(whole)})


def at_back(price: str, n: int) -> Column:
    """Aggregate over a numbered table: the n-th known price from the end (0 is the last)."""
    return F.max(F.when(F.col("_back") == n + 1, F.col(price)))


def period_return(df: DataFrame, n: int, price: str = "adj_close", by: Sequence[str] = KEYS) -> DataFrame:
    """Last price over the one n known prices earlier; NULL where there are not that many."""
    return numbered_back(df, price, by).groupBy(*by).agg(growth(at_back(price, 0), at_back(price, n)).alias("ret"))


def ytd(price: str) -> Column:
    """Aggregate over a numbered table: the last price over the last before its year, else over the first of
    the year if there are two."""
    year = F.trunc(F.col("_last").cast("date"), "year").cast("timestamp_ntz")
    t = F.when(F.col(price).isNotNull(), F.col("date").cast("timestamp_ntz"))
    earlier = F.max_by(price, F.when(t < year, t))
    here = F.when(t >= year, t)
    first = F.when(F.count(here) >= 2, F.min_by(price, here))
    return growth(at_back(price, 0), F.coalesce(earlier, first))


def trailing(price: str, horizons: Sequence[int] = (1, 5, 21)) -> list[Column]:
    """Aggregates over a numbered table: ret_1, ret_5, ret_21 (one column a horizon) and ret_ytd."""
    return [*(growth(at_back(price, 0), at_back(price, n)).alias(f"ret_{n}") for n in horizons), ytd(price).alias("ret_ytd")]


def trailing_returns(df: DataFrame, price: str = "adj_close", horizons: Sequence[int] = (1, 5, 21), by: Sequence[str] = KEYS) -> DataFrame:
    return numbered_back(df, price, by).groupBy(*by).agg(*trailing(price, horizons))


def ytd_return(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS) -> DataFrame:
    return trailing_returns(df, price, (), by)


def total(price: str = "adj_close") -> Column:
    known = F.when(F.col(price).isNotNull(), F.col("date"))
    return F.when(F.count(price) >= 2, growth(F.max_by(price, known), F.min_by(price, known)))


def annual(base: Column, n: Column, td: int = TD) -> Column:
    """Growth factor over n periods as a rate per td periods; NULL unless both are positive."""
    return F.when((base > 0) & (n > 0), F.pow(base, F.lit(float(td)) / n) - 1)


def cagr(price: str = "adj_close", td: int = TD) -> Column:
    return annual(total(price) + 1, F.count(price) - 1, td)


def total_return_cagr(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS, td: int = TD) -> DataFrame:
    return df.groupBy(*by).agg(total(price).alias("total_return"), cagr(price, td).alias("cagr"))


def cagr_from_returns(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS, td: int = TD) -> DataFrame:
    return df.groupBy(*by).agg(annual(F.product(1 + F.col(ret)), F.count(ret), td).alias("cagr"))


def best_worst(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS) -> DataFrame:
    return df.groupBy(*by).agg(F.max(ret).alias("best"), F.min(ret).alias("worst"))


def period_end(rule: str, day: Column) -> Column:
    """The label of a calendar bin: month end, the week's Sunday, or year end."""
    if rule == "ME":
        return F.last_day(day)
    if rule == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if rule == "YE":
        return F.date_sub(F.add_months(F.trunc(day, "year"), 12), 1).cast("date")
    raise ValueError(f"unknown rule {rule}")


def resample_returns(df: DataFrame, rule: str, ret: str = "ret", by: Sequence[str] = KEYS) -> DataFrame:
    """Compounded returns per calendar bin, labelled by its end; bins without rows are 0."""
    bins = df.groupBy(*by, period_end(rule, F.col("date").cast("date")).alias("period")).agg((F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))) - 1).alias("ret"))
    step = {"ME": "interval 1 month", "W": "interval 7 days", "YE": "interval 1 year"}[rule]
    span = bins.groupBy(*by).agg(F.min("period").alias("a"), F.max("period").alias("b"))
    start = F.trunc("a", "month") if rule == "ME" else F.trunc("a", "year") if rule == "YE" else F.col("a")
    every = span.select(*by, F.explode(F.sequence(start, F.col("b"), F.expr(step))).alias("d")).select(*by, period_end(rule, F.col("d")).alias("period"))
    return every.join(bins, [*by, "period"], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def last_periods(df: DataFrame, n: int = 24, by: Sequence[str] = KEYS) -> DataFrame:
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("period").desc()))).filter(F.col("_k") <= n).drop("_k")
