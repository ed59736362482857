"""Strategies and long/flat backtests with costs, for all assets and segments in one pass."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..config import CONFIG, KEYS
from ..functions.kept import kept
from ..functions.series import BLOCK, framed, running
from ..functions.windows import growth, over, ratio
from .indicators import rsi, sma
from .returns import TD, annual, total
from .volatility import annualized


class Strategy(Protocol):
    """Anything with signal(df, by) that adds `signal`, the wanted position (0 or 1) of each bar, known at
    its close. A strategy that looks at no more than some number of earlier bars may say so as `rows`; its signal then
    takes block too (None: plain windows), and a backtest gets signals and positions from the same frames."""

    def signal(self, df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame: ...

    def params(self) -> dict[str, str]: ...

    def describe(self) -> str: ...


@dataclass(frozen=True)
class MovingAverageCrossover:
    """Long while the fast average is above the slow one."""

    fast: int = CONFIG.strategies.ma[0]
    slow: int = CONFIG.strategies.ma[1]

    def __post_init__(self):
        if self.fast >= self.slow:
            raise ValueError("fast must be below slow")

    @property
    def rows(self) -> int:
        return self.slow - 1

    def signal(self, df: DataFrame, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
        above = lambda d, keys: d.withColumn("signal", F.when(sma(self.fast, "close", keys) > sma(self.slow, "close", keys), 1.0).otherwise(0.0))
        return framed(df, self.rows, above, by, block=block)

    def params(self) -> dict[str, str]:
        return {"fast": str(self.fast), "slow": str(self.slow)}

    def describe(self) -> str:
        return f"long while SMA{self.fast} > SMA{self.slow}"


@dataclass(frozen=True)
class RSIMeanReversion:
    """Long from RSI below entry until RSI above exit. The two exclude each other, so the state is the
    last of them that happened; an unknown RSI gives 0 and keeps the state."""

    period: int = CONFIG.strategies.rsi[0]
    entry: float = CONFIG.strategies.rsi[1]
    exit: float = CONFIG.strategies.rsi[2]

    def __post_init__(self):
        if self.entry >= self.exit:
            raise ValueError("entry must be below exit")

    def signal(self, df: DataFrame, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
        df = rsi(df, self.period, "close", "_rsi", by, block)
        turn = F.when(F.col("_rsi") < self.entry, 1.0).when(F.col("_rsi") > self.exit, 0.0)
        df = running(df, {"_held": ("last", turn)}, by, block=block)
        held = F.coalesce("_held", F.lit(0.0))
        return df.withColumn("signal", F.when(F.col("_rsi").isNull(), 0.0).otherwise(held)).drop("_rsi", "_held")

    def params(self) -> dict[str, str]:
        return {"period": str(self.period), "entry": str(self.entry), "exit": str(self.exit)}

    def describe(self) -> str:
        return f"long from RSI{self.period} < {self.entry} to > {self.exit}"


def _in_order(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Assets in one task each, in date order: what a function of the user's follows from bar to bar."""
    return df.repartition(*by).sortWithinPartitions(*by, "date")


@dataclass(frozen=True)
class PandasStrategy:
    """A user's function from one asset's bars (pandas, in date order) to its signals. The function sees the whole asset,
    which the task holds in memory; `ChunkedStrategy` does not."""

    function: Callable[[pd.DataFrame], pd.Series]
    name: str = "custom"

    def signal(self, df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
        function = self.function

        def run(bars: pd.DataFrame) -> pd.DataFrame:
            bars = bars.sort_values("date").reset_index(drop=True)
            return bars.assign(signal=pd.to_numeric(function(bars)).fillna(0.0).astype(float).to_numpy())

        return df.groupBy(*by).applyInPandas(run, StructType([*df.schema.fields, StructField("signal", DoubleType())]))

    def params(self) -> dict[str, str]:
        return {}

    def describe(self) -> str:
        return self.name


@dataclass(frozen=True)
class ChunkedStrategy:
    """A user's function from (state, chunk) to (signals, state): an asset's bars come in date order as chunks of at most
    `rows` bars, with the state that the function returned before (None for the first), so memory does not grow with the
    asset. Signals that are no numbers are 0."""

    function: Callable[[Any, pd.DataFrame], tuple[pd.Series, Any]]
    name: str = "custom"
    rows_a_chunk: int = 10_000

    def signal(self, df: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
        function, keys, most = self.function, list(by), self.rows_a_chunk

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asset, state = None, None
            for batch in batches:
                # a batch holds several assets, and an asset several batches
                change = (batch[keys] != batch[keys].shift()).any(axis=1)
                for _, bars in batch.groupby(change.cumsum(), sort=False):
                    own = tuple(bars[keys].iloc[0])
                    if own != asset:
                        asset, state = own, None
                    for start in range(0, len(bars), most):
                        chunk = bars.iloc[start : start + most].reset_index(drop=True)
                        signals, state = function(state, chunk)
                        yield chunk.assign(signal=pd.to_numeric(signals).fillna(0.0).astype(float).to_numpy())

        return _in_order(df, by).mapInPandas(run, StructType([*df.schema.fields, StructField("signal", DoubleType())]))

    def params(self) -> dict[str, str]:
        return {}

    def describe(self) -> str:
        return self.name


@dataclass(frozen=True)
class CostModel:
    cost_bps: float = CONFIG.backtest.cost_bps
    slippage_bps: float = CONFIG.backtest.slippage_bps

    @property
    def bps_per_side(self) -> float:
        return self.cost_bps + self.slippage_bps

    @property
    def fraction(self) -> float:
        return self.bps_per_side / 10_000

    def execution_price(self, price: Column, side: Column) -> Column:
        """What a buy (side 1) or a sale (side -1) at price comes to with slippage."""
        return price * (1 + side * (self.slippage_bps / 10_000))


def split_dev_oos(df: DataFrame, dev: tuple[date, date] = CONFIG.backtest.dev, oos: tuple[date, date] = CONFIG.backtest.oos) -> DataFrame:
    """Adds segment: dev or oos, both ends included; other rows go."""
    d = F.col("date").cast("date")
    segment = F.when(d.between(*dev), "dev").when(d.between(*oos), "oos")
    return df.withColumn("segment", segment).filter("segment is not null")


def run_backtest(df: DataFrame, strategy: Strategy | None, capital: float | None = None, costs: CostModel | None = None, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Daily rows: close, signal, ret, position (yesterday's signal), turnover, cost, gross_ret, net_ret,
    equity, gross_equity, benchmark. strategy None takes the column signal of df (NULL is 0)."""
    capital, costs = capital or CONFIG.backtest.capital, costs or CostModel()
    df = df.filter(F.col("close").isNotNull())
    rows = 0 if strategy is None else getattr(strategy, "rows", None)
    if rows is None:
        df, strategy, rows = kept(strategy.signal(df, by), "signals"), None, 0
    own = [*by, "date", "close", "signal"]

    def positions(d: DataFrame, keys: list[str]) -> DataFrame:
        d = d if strategy is None else strategy.signal(d, keys, None)
        w = over(keys)
        d = d.withColumn("signal", F.coalesce(F.col("signal").cast("double"), F.lit(0.0)))
        d = d.withColumns({"ret": F.coalesce(growth("close", F.lag("close").over(w)), F.lit(0.0)), "position": F.coalesce(F.lag("signal").over(w), F.lit(0.0))})
        return d.withColumn("turnover", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0.0))))

    df = framed(df.select(*(c for c in df.columns if c in own or strategy)), rows + 2, positions, by, block=block).select(*own, "ret", "position", "turnover")
    df = df.withColumn("cost", F.col("turnover") * costs.fraction).withColumn("gross_ret", F.col("position") * F.col("ret"))
    df = df.withColumn("net_ret", F.col("gross_ret") - F.col("cost"))
    made = {"equity": "net_ret", "gross_equity": "gross_ret", "benchmark": "ret"}
    df = running(df, {e: ("product", 1 + F.col(r)) for e, r in made.items()}, by, block=block)
    return df.withColumns({e: F.col(e) * F.lit(float(capital)) for e in made})


def extract_trades(daily: DataFrame, by: Sequence[str] = KEYS, block: str | None = BLOCK) -> DataFrame:
    """Spans from the first bar with position 1 to the first with 0 (included, so the exit's cost is in), or to
    the last bar; other positions neither open nor close one: trade_id, entry_date, exit_date, entry_price,
    exit_price, bars_held, ret."""
    turn = F.when(F.col("position") == 1, True).when(F.col("position") == 0, False)
    rows = running(daily.select(*by, "date", "close", "net_ret", "position"), {"_on": ("last", turn), "_was": ("before", turn), "_n": ("count", F.lit(1))}, by, block=block)
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_on", "_was")})
    rows = running(rows.filter(F.col("_on") | F.col("_was")), {"trade_id": ("sum", F.when(F.col("_on") & ~F.col("_was"), 1).otherwise(0))}, by, block=block)
    return rows.groupBy(*by, "trade_id").agg(
        F.min("date").alias("entry_date"),
        F.max("date").alias("exit_date"),
        F.min_by("close", "date").alias("entry_price"),
        F.max_by("close", "date").alias("exit_price"),
        (F.max("_n") - F.min("_n")).cast("long").alias("bars_held"),
        (F.product(1 + F.col("net_ret")) - 1).alias("ret"),
    )


def sharpe(ret: str, rf: float, td: int = TD) -> Column:
    """Aggregate: NULL with fewer than two returns or no deviation."""
    return ratio(F.avg(ret) - rf / td, F.stddev_samp(ret)) * td**0.5


def trade_stats(trades: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """num_trades, win_rate, avg_trade_return, profit_factor (infinite without losses if there is profit)."""
    won, lost = F.sum(F.when(F.col("ret") > 0, F.col("ret"))), -F.sum(F.when(F.col("ret") < 0, F.col("ret")))
    factor = F.when(F.coalesce(lost, F.lit(0.0)) > 0, F.try_divide(F.coalesce(won, F.lit(0.0)), lost)).when(won > 0, F.lit(float("inf")))
    return trades.filter("ret is not null").groupBy(*by).agg(F.count("*").alias("num_trades"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.avg("ret").alias("avg_trade_return"), factor.alias("profit_factor"))


def performance(equity: str, ret: str, peak: str, rf: float, td: int) -> list[Column]:
    """Aggregates over daily rows; peak: the column with the highest equity so far."""
    return [
        total(equity).alias("total_return"),
        annual(total(equity) + 1, F.count(equity) - 1, td).alias("cagr"),
        annualized(ret, td).alias("volatility"),
        sharpe(ret, rf, td).alias("sharpe"),
        F.min(growth(equity, peak)).alias("max_drawdown"),
    ]


def compute_metrics(daily: DataFrame, trades: DataFrame, rf: float | None = None, equity: str = "equity", ret: str = "net_ret", by: Sequence[str] = KEYS, td: int = TD, block: str | None = BLOCK) -> DataFrame:
    """One row per asset: total_return, cagr, volatility, sharpe, max_drawdown and the trades' statistics."""
    rf = CONFIG.analysis.risk_free if rf is None else rf
    rows = running(daily, {"_peak": ("max", equity)}, by, block=block)
    out = rows.groupBy(*by).agg(*performance(equity, ret, "_peak", rf, td))
    return out.join(trade_stats(trades, by), list(by), "left").withColumn("num_trades", F.coalesce("num_trades", F.lit(0)))


#: The metrics of a bundle, in the order of its table.
METRICS = ("total_return", "cagr", "volatility", "sharpe", "max_drawdown", "win_rate", "num_trades", "avg_trade_return", "profit_factor")


def metrics_bundle(daily: DataFrame, rf: float | None = None, by: Sequence[str] = KEYS, td: int = TD, block: str | None = BLOCK) -> DataFrame:
    """net, gross and benchmark metrics, a row each per asset; gross and net share the net trades, the
    benchmark counts as one trade without statistics. One pass over daily for all three, one for the trades."""
    rf = CONFIG.analysis.risk_free if rf is None else rf
    kinds = {"net": ("equity", "net_ret"), "gross": ("gross_equity", "gross_ret"), "benchmark": ("benchmark", "ret")}
    daily = daily if block is None else kept(daily, "daily")  # read by the peaks and the trades, several times each
    rows = running(daily, {f"_peak_{k}": ("max", e) for k, (e, _) in kinds.items()}, by, block=block)
    own = [c.alias(f"{k}_{i}") for k, (e, r) in kinds.items() for i, c in enumerate(performance(e, r, f"_peak_{k}", rf, td))]
    out = rows.groupBy(*by).agg(*own).join(trade_stats(extract_trades(daily, by, block), by), list(by), "left")
    each = [F.struct(F.lit(k).alias("kind"), *(F.col(f"{k}_{i}").alias(m) for i, m in enumerate(METRICS[:5]))) for k in kinds]
    out = out.select("*", F.explode(F.array(*each)).alias("_m")).select(*by, "_m.*", "num_trades", "win_rate", "avg_trade_return", "profit_factor")
    traded = F.col("kind") != "benchmark"
    stats = {c: F.when(traded, F.col(c)) for c in ("win_rate", "avg_trade_return", "profit_factor")}
    return out.withColumns({**stats, "num_trades": F.when(traded, F.coalesce("num_trades", F.lit(0))).otherwise(1).cast("long")})


def metrics_table(bundle: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """The bundle by metric: metric, and a column for each kind."""
    doubles = bundle.select(*by, "kind", *(F.col(n).cast("double").alias(n) for n in METRICS))
    long = doubles.unpivot([*by, "kind"], list(METRICS), "metric", "value")
    return long.groupBy(*by, "metric").pivot("kind", ["benchmark", "gross", "net"]).agg(F.first("value"))
