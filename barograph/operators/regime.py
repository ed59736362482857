"""Volatility regimes and trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONFIG, KEYS
from ..functions.kept import kept
from ..functions.series import BLOCK, cut, earlier, framed
from ..functions.windows import gate, over, rolling
from .volatility import TD, with_volatility

LOW, NORMAL, HIGH = "Low", "Normal", "High"
BULLISH, NEUTRAL, BEARISH = "Bullish", "Neutral", "Bearish"
#: Blocks and value cells of expanding quantiles: a frame sorts about three times a block's values.
QUANTILE_BLOCK, CELLS = "month", 64


def expanding_quantiles(df: DataFrame, x: str, wanted: dict[str, float], least: int, by: Sequence[str] = KEYS, order: str = "date", block: str = QUANTILE_BLOCK, cells: int = CELLS) -> DataFrame:
    """Adds exact quantiles (linear between neighbours) of the known values of x up to each row, given as shares by
    name; NULL until `least` values are known.

    While a block with m values passes, a quantile's rank among the values before the block moves by m at most. So a
    block needs only the earlier values of about 2m ranks, and how many lie below them. Counts of value cells and
    blocks tell which cells hold these ranks; of their values only those ranks go to the block, so a frame has about
    3m values however long the series is and however many of its values are equal."""
    df = cut(df, block, order)
    keys = [*by, "_block"]
    known = df.filter(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_v"))
    cuts = known.groupBy(*by).agg(F.percentile_approx("_v", [k / cells for k in range(1, cells)], 1000).alias("_cuts"))
    cell = F.size(F.filter(F.array_distinct("_cuts"), lambda c: c < F.col("_v"))).alias("_cell")
    values = known.join(cuts, list(by)).select(*keys, "_v", cell).groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("_f"))

    counts = values.groupBy(*keys, "_cell").agg(F.sum("_f").alias("_n"))
    sizes = counts.groupBy(*keys).agg(F.sum("_n").alias("_m"))
    sizes = sizes.withColumn("_all", F.coalesce(F.sum("_m").over(earlier(by)), F.lit(0)))
    grid = sizes.select(*keys, "_m", "_all", F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("_cell"))
    grid = grid.join(counts, [*keys, "_cell"], "left").withColumn("_past", F.coalesce(F.sum("_n").over(earlier([*by, "_cell"])), F.lit(0)))
    grid = grid.withColumn("_below", F.sum("_past").over(over(keys, "_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_past"))
    ranks = [F.struct(F.lit(k).alias("q"), (F.floor(F.col("_all") * q) - F.col("_m") - 1).alias("low"), (F.ceil((F.col("_all") + F.col("_m")) * q) + 1).alias("high")) for k, q in enumerate(wanted.values())]
    held = grid.filter("_past > 0").withColumn("_r", F.explode(F.array(*ranks))).filter("_below <= _r.high and _below + _past > _r.low")
    near = held.select(*by, F.col("_block").alias("_to"), "_cell", "_below", "_r").join(values, [*by, "_cell"]).filter(F.col("_block") < F.col("_to"))
    near = near.groupBy(*by, "_to", "_r", "_v").agg(F.sum("_f").alias("_f"), F.min("_below").alias("_below"))
    group = Window.partitionBy(*by, "_to", "_r")
    first = F.min("_below").over(group) + F.sum("_f").over(group.orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_f")
    near = near.withColumn("_rank", first)
    start, stop = F.greatest("_rank", "_r.low"), F.least(F.col("_rank") + F.col("_f"), F.col("_r.high") + 1)
    near = near.withColumns({"_from": start, "_copies": stop - start}).filter("_copies > 0")
    past = near.select(*by, F.col("_to").alias("_block"), F.col("_r.q").alias("_q"), "_from", F.explode(F.array_repeat("_v", F.col("_copies").cast("int"))).alias("_v"))

    rows = df.withColumns({"_q": F.lit(-1), "_v": F.col(x).cast("double")}).join(sizes.select(*keys, "_all"), keys, "left")
    rows = rows.unionByName(past, allowMissingColumns=True)
    frame = Window.partitionBy(*keys).orderBy(F.col("_q") < 0, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    made = rows.withColumn("_n", F.count(F.when(F.col("_q") == -1, F.col("_v"))).over(frame) + F.coalesce("_all", F.lit(0)))
    for k in range(len(wanted)):
        near_k = F.when(F.col("_q").isin(k, -1), F.col("_v"))
        made = made.withColumns({f"_s{k}": F.sort_array(F.collect_list(near_k).over(frame)), f"_u{k}": F.coalesce(F.min(F.when(F.col("_q") == k, F.col("_from"))).over(frame), F.lit(0))})
    made = made.filter((F.col("_q") == -1))
    for k, (out, q) in enumerate(wanted.items()):
        place = (F.col("_n") - 1) * F.lit(q)
        at = (F.floor(place) - F.col(f"_u{k}")).cast("int")
        low, high = F.get(f"_s{k}", at), F.get(f"_s{k}", at + 1)
        part = place - F.floor(place)
        made = made.withColumn(out, F.when(F.col(x).isNotNull() & (F.col("_n") >= least), F.when(part > 0, low + (high - low) * part).otherwise(low)))
    return made.select(*(c for c in df.columns if c != "_block"), *wanted)


def with_regime(df: DataFrame, ret: str = "ret", vol_window: int | None = None, low: float | None = None, high: float | None = None, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds vol (rolling), low_threshold, high_threshold (exact expanding quantiles, NULL until vol_window
    volatilities are known) and regime. High goes before Low where both hold; without thresholds the
    regime is Normal, without a volatility NULL."""
    a = CONFIG.analysis.regime
    n, low, high = vol_window or a[2], a[0] if low is None else low, a[1] if high is None else high
    df = kept(with_volatility(df, {"vol": n}, ret, by, block), "volatility")  # read four times
    df = expanding_quantiles(df, "vol", {"low_threshold": low, "high_threshold": high}, n, by)
    v, lo, hi = (F.round(c, 12) for c in ("vol", "low_threshold", "high_threshold"))  # ties up to rounding
    return df.withColumn("regime", F.when(v >= hi, HIGH).when(v <= lo, LOW).when(v.isNotNull(), NORMAL))


def regime_series(df: DataFrame, ret: str = "ret", vol_window: int | None = None, low: float | None = None, high: float | None = None, by: Sequence[str] = KEYS) -> DataFrame:
    """The rows of with_regime that have a volatility."""
    return with_regime(df, ret, vol_window, low, high, by).filter(F.col("vol").isNotNull())


def latest_trend(price: str) -> Column:
    """Aggregate over trend_series: the trend at the last known price, Neutral without any."""
    return F.coalesce(F.max_by("trend", F.when(F.col(price).isNotNull(), F.col("date"))), F.lit(NEUTRAL))


def regime_now(vol: str = "vol", vol_window: int | None = None, low: float | None = None, high: float | None = None) -> Column:
    """Aggregate over rows with a rolling volatility: the regime at the last known one, or Unknown. Its thresholds
    are percentiles of all that are known, so neither Python nor a whole series in one place is needed."""
    a = CONFIG.analysis.regime
    n, low, high = vol_window or a[2], a[0] if low is None else low, a[1] if high is None else high
    now = F.round(F.max_by(vol, F.when(F.col(vol).isNotNull(), F.col("date"))), 12)
    enough = F.count(vol) >= n
    lo, hi = (F.round(F.when(enough, F.percentile(vol, x)), 12) for x in (low, high))
    return F.when(now.isNull(), "Unknown").when(now >= hi, HIGH).when(now <= lo, LOW).otherwise(NORMAL)


def current_regime(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """The last regime of `regime_series`, without the series."""
    return with_volatility(df, {"vol": CONFIG.analysis.regime[2]}, ret, by, block).groupBy(*by).agg(regime_now().alias("regime"))


def performance_by_regime(df: DataFrame, ret: str = "ret", by: Sequence[str] = KEYS) -> DataFrame:
    """days, mean_ret, vol, share per asset and regime; regime_order sorts Low, Normal, High."""
    rows = regime_series(df, ret, by=by).filter(F.col(ret).isNotNull())
    out = rows.groupBy(*by, "regime").agg(F.count("*").alias("days"), F.avg(ret).alias("mean_ret"), (F.stddev_samp(ret) * TD**0.5).alias("vol"))
    out = out.withColumn("share", F.col("days") / F.sum("days").over(Window.partitionBy(*by)))
    return out.withColumn("regime_order", F.when(F.col("regime") == LOW, 0).when(F.col("regime") == NORMAL, 1).otherwise(2))


def trend_series(df: DataFrame, price: str = "adj_close", fast: int | None = None, slow: int | None = None, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Adds sma_fast, sma_slow and trend; Neutral where an average is unknown."""
    a = CONFIG.analysis.trend
    fast, slow = fast or a[0], slow or a[1]
    averages = lambda d, keys: d.withColumns({name: gate(price, F.avg(price).over(rolling(n, keys)), n, keys) for name, n in (("sma_fast", fast), ("sma_slow", slow))})
    df = framed(df, max(fast, slow) - 1, averages, by, block=block)
    p, f, s = F.col(price), F.col("sma_fast"), F.col("sma_slow")
    return df.withColumn("trend", F.when((p < f) & (f < s), BEARISH).when((p > f) & (f > s), BULLISH).otherwise(NEUTRAL))


def current_trend(df: DataFrame, price: str = "adj_close", by: Sequence[str] = KEYS) -> DataFrame:
    return trend_series(df, price, by=by).groupBy(*by).agg(latest_trend(price).alias("trend"))
