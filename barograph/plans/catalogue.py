"""Registered queries: each applies an operator to bars derived from the whole test tables, and has an
SQL form for DuckDB. Doubles are rounded on both sides, as sums may differ in their last digits."""

from __future__ import annotations

import uuid
from datetime import date

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions.kept import kept, shared_folder
from ..operators import backtest as bt
from ..operators import clean, correlation, drawdown, eventstudy, indicators, regime, returns, summary, volatility
from ..operators.asof import asof
from ..functions.series import BLOCK
from ..sources import bars as src
from ..sources import events as cal
from ..sources.store import BarTable
from . import sql

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def walk(spark: SparkSession, sf_dir: str, block: str | None = BLOCK) -> DataFrame:
    """block None suits the summaries, which pass over an asset once."""
    return clean.add_returns(src.walk_bars(table(spark, sf_dir, "lineitem"), block), block=block)


def ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.add_returns(src.interval_bars(table(spark, sf_dir, "events")))


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars with planted faults: holes in open, close and volume, contradicting and repeated rows."""
    df = src.interval_bars(table(spark, sf_dir, "events"))
    from ..functions.windows import over

    df = df.withColumn("rn", F.row_number().over(over()))
    hit = lambda m, k: F.col("rn") % m == k
    df = df.withColumns({
        "open": F.when(~hit(17, 3), F.col("open")),
        "high": F.when(hit(23, 5), F.col("low") - 1).otherwise(F.col("high")),
        "close": F.when(~hit(29, 7), F.col("close")),
        "volume": F.when(~hit(13, 4), F.col("volume")),
        "adj_close": F.when(~hit(29, 7), F.col("close")),
        "ingest_seq": F.lit(1),
    })
    again = df.filter(hit(11, 2)).withColumns({"close": F.col("close") + 1, "adj_close": F.col("close") + 1, "high": F.col("high") + 1, "ingest_seq": F.lit(2)})
    return df.unionByName(again).drop("rn")


def quarter_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first order day of each quarter, as events."""
    d = F.col("o_orderdate")
    days = table(spark, sf_dir, "orders").groupBy(F.date_trunc("quarter", d).alias("q")).agg(F.min(d).cast("date").alias("date"))
    return days.select("date", F.lit("US").alias("country"), F.lit(cal.EVENT_TYPES[0]).alias("event"))


def shown(df: DataFrame, *cols: str, day: bool = True, digits: int = 6) -> DataFrame:
    """The named columns, doubles rounded (and without negative zero), times as days if day."""
    kinds = dict(df.dtypes)
    out = []
    for c in cols or df.columns:
        if kinds[c] == "double":
            out.append((F.round(c, digits) + F.lit(0.0)).alias(c))
        elif kinds[c].startswith("timestamp") and day:
            out.append(F.col(c).cast("date").alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


@query(sql.CLEAN_BARS)
def clean_bars(spark, sf_dir):
    return shown(clean.clean_bars(raw_bars(spark, sf_dir)), day=False)


@query(sql.CLEAN_REPORT)
def clean_report(spark, sf_dir):
    return clean.cleaning_report(raw_bars(spark, sf_dir))


@query(sql.RETURNS)
def daily_log_returns(spark, sf_dir):
    return shown(walk(spark, sf_dir), "asset_key", "date", "close", "ret", "log_ret")


@query(sql.CUMULATIVE)
def cumulative_returns(spark, sf_dir):
    return shown(returns.cumulative_returns(walk(spark, sf_dir)), "asset_key", "date", "cum_ret")


@query(sql.TRAILING)
def trailing_returns(spark, sf_dir):
    return shown(returns.trailing_returns(walk(spark, sf_dir, None)))


@query(sql.PERIOD)
def period_return(spark, sf_dir):
    return shown(returns.period_return(walk(spark, sf_dir, None), 63))


@query(sql.TOTAL)
def total_return_cagr(spark, sf_dir):
    return shown(returns.total_return_cagr(walk(spark, sf_dir)))


@query(sql.CAGR)
def cagr_from_returns(spark, sf_dir):
    return shown(returns.cagr_from_returns(walk(spark, sf_dir)))


@query(sql.BEST)
def best_worst_day(spark, sf_dir):
    return shown(returns.best_worst(walk(spark, sf_dir)))


@query(sql.resample("last_day(CAST(date AS DATE))", "date_trunc('month', p)", "INTERVAL 1 MONTH", "last_day(CAST(d AS DATE))"))
def resample_monthly(spark, sf_dir):
    return shown(returns.resample_returns(walk(spark, sf_dir), "ME"))


@query(sql.resample("CAST(date AS DATE) + CAST((7 - isodow(CAST(date AS DATE))) % 7 AS INTEGER)", "p", "INTERVAL 7 DAY", "CAST(d AS DATE)", "ohlc"))
def resample_weekly(spark, sf_dir):
    return shown(returns.resample_returns(ohlc(spark, sf_dir), "W"))


@query(sql.resample("make_date(CAST(year(date) AS INTEGER), 12, 31)", "date_trunc('year', p)", "INTERVAL 1 YEAR", "make_date(CAST(year(d) AS INTEGER), 12, 31)"))
def resample_yearly(spark, sf_dir):
    return shown(returns.resample_returns(walk(spark, sf_dir), "YE"))


@query(sql.LAST24)
def last_24_months(spark, sf_dir):
    return shown(returns.last_periods(returns.resample_returns(walk(spark, sf_dir), "ME"), 24))


@query(sql.ROLLING_VOL)
def rolling_vol(spark, sf_dir):
    return shown(volatility.volatility_frame(walk(spark, sf_dir)), "asset_key", "date", "vol_20d", "vol_60d")


@query(sql.ANNUAL_VOL)
def annualized_vol(spark, sf_dir):
    return shown(volatility.annualized_volatility(walk(spark, sf_dir)))


@query(sql.REALIZED_VOL)
def realized_vol(spark, sf_dir):
    return shown(volatility.realized_volatility(walk(spark, sf_dir, None), 20))


@query(sql.DRAWDOWN)
def drawdown_series(spark, sf_dir):
    return shown(drawdown.drawdown_series(walk(spark, sf_dir)), "asset_key", "date", "peak", "drawdown")


@query(sql.DRAWDOWN_RET)
def drawdown_from_returns(spark, sf_dir):
    return shown(drawdown.drawdown_from_returns(walk(spark, sf_dir)), "asset_key", "date", "equity", "peak", "drawdown")


@query(sql.DRAWDOWN_STATS)
def max_drawdown_stats(spark, sf_dir):
    return shown(drawdown.max_drawdown_stats(walk(spark, sf_dir)))


@query(sql.REGIME)
def regime_series(spark, sf_dir):
    return shown(regime.regime_series(walk(spark, sf_dir)), "asset_key", "date", "vol", "low_threshold", "high_threshold", "regime")


@query(sql.REGIME_NOW)
def current_regime(spark, sf_dir):
    return regime.current_regime(walk(spark, sf_dir))


@query(sql.REGIME_PERF)
def performance_by_regime(spark, sf_dir):
    return shown(regime.performance_by_regime(walk(spark, sf_dir)))


@query(sql.TREND)
def trend_series(spark, sf_dir):
    return shown(regime.trend_series(walk(spark, sf_dir)), "asset_key", "date", "sma_fast", "sma_slow", "trend")


@query(sql.TREND_NOW)
def current_trend(spark, sf_dir):
    return regime.current_trend(walk(spark, sf_dir))


@query(sql.CORR)
def correlation_matrix(spark, sf_dir):
    return shown(correlation.correlation_matrix(walk(spark, sf_dir)))


@query(sql.SPEARMAN)
def correlation_spearman(spark, sf_dir):
    bars = walk(spark, sf_dir).withColumn("ret", F.round("ret", 9))  # equal moves are ties
    return shown(correlation.correlation_matrix(bars, method="spearman"))


@query(sql.KENDALL)
def correlation_kendall_monthly(spark, sf_dir):
    months = returns.resample_returns(walk(spark, sf_dir), "ME").select("asset_key", F.col("period").alias("date"), F.round("ret", 9).alias("ret"))
    return shown(correlation.correlation_matrix(months, method="kendall"))


@query(sql.KENDALL_DAILY)
def correlation_kendall(spark, sf_dir):
    bars = walk(spark, sf_dir).withColumn("ret", F.round("ret", 9))
    return shown(correlation.correlation_matrix(bars, method="kendall"))


@query(sql.ROLLING_CORR)
def rolling_correlation(spark, sf_dir):
    return shown(correlation.rolling_correlation(walk(spark, sf_dir), "A", "N", 60))


@query(sql.COMPARATIVE)
def comparative_returns(spark, sf_dir):
    out = correlation.comparative_returns(ohlc(spark, sf_dir)).withColumn("log_growth", F.log1p("cum_ret"))
    return shown(out, "asset_key", "date", "log_growth", day=False, digits=3)


@query(sql.NORMALISED)
def normalised_prices(spark, sf_dir):
    out = correlation.normalised_prices(ohlc(spark, sf_dir)).withColumn("log_growth", F.log1p("cum_ret"))
    return shown(out, "asset_key", "date", "log_growth", day=False, digits=3)


@query(sql.VOL_COMPARE)
def volatility_comparison(spark, sf_dir):
    return shown(correlation.volatility_comparison(ohlc(spark, sf_dir), 20), day=False)


@query(sql.ALIGNED)
def aligned_returns(spark, sf_dir):
    return shown(correlation.aligned(walk(spark, sf_dir), "ret", ["A", "N", "R"]))


@query(sql.ALIGNED_PRICES)
def aligned_prices(spark, sf_dir):
    return shown(correlation.aligned(walk(spark, sf_dir), "adj_close", ["A", "N", "R"]))


@query(sql.MOVING)
def moving_averages(spark, sf_dir):
    return shown(indicators.moving_averages(walk(spark, sf_dir)), "asset_key", "date", "sma_20", "sma_50", "sma_200", "ema_20", "ema_50")


@query(sql.RSI)
def rsi(spark, sf_dir):
    return shown(indicators.rsi(walk(spark, sf_dir)), "asset_key", "date", "rsi")


@query(sql.MACD)
def macd(spark, sf_dir):
    return shown(indicators.macd(walk(spark, sf_dir)), "asset_key", "date", "macd", "macd_signal", "macd_histogram")


@query(sql.BOLLINGER)
def bollinger(spark, sf_dir):
    return shown(indicators.bollinger(walk(spark, sf_dir)), "asset_key", "date", "bb_middle", "bb_upper", "bb_lower", "bb_width")


@query(sql.ATR)
def true_range_atr(spark, sf_dir):
    return shown(indicators.atr(ohlc(spark, sf_dir)), "asset_key", "date", "true_range", "atr", day=False)


@query(sql.SIGNAL_MA)
def signal_ma(spark, sf_dir):
    return shown(bt.MovingAverageCrossover().signal(walk(spark, sf_dir)), "asset_key", "date", "signal")


@query(sql.SIGNAL_RSI)
def signal_rsi(spark, sf_dir):
    return shown(bt.RSIMeanReversion().signal(walk(spark, sf_dir)), "asset_key", "date", "signal")


DAILY = ("close", "signal", "ret", "position", "turnover", "cost", "gross_ret", "net_ret", "equity", "gross_equity", "benchmark")


@query(sql.BACKTEST)
def backtest_daily(spark, sf_dir):
    return shown(bt.run_backtest(walk(spark, sf_dir), bt.MovingAverageCrossover()), "asset_key", "date", *DAILY, digits=4)


@query(sql.BACKTEST_RSI)
def backtest_rsi_daily(spark, sf_dir):
    return shown(bt.run_backtest(walk(spark, sf_dir), bt.RSIMeanReversion()), "asset_key", "date", *DAILY, digits=4)


@query(sql.TRADES)
def backtest_trades(spark, sf_dir):
    return shown(bt.extract_trades(bt.run_backtest(walk(spark, sf_dir), bt.MovingAverageCrossover())))


@query(sql.METRICS)
def backtest_metrics(spark, sf_dir):
    daily = kept(bt.run_backtest(walk(spark, sf_dir), bt.MovingAverageCrossover()), "daily")
    return shown(bt.compute_metrics(daily, bt.extract_trades(daily)))


@query(sql.METRICS_TABLE)
def backtest_metrics_table(spark, sf_dir):
    return shown(bt.metrics_table(bt.metrics_bundle(bt.run_backtest(walk(spark, sf_dir), bt.MovingAverageCrossover()))))


@query(sql.OOS)
def backtest_oos(spark, sf_dir):
    parts = bt.split_dev_oos(walk(spark, sf_dir), (date(1995, 1, 1), date(1999, 12, 31)), (date(2000, 1, 1), date(2001, 12, 31)))
    by = ["asset_key", "segment"]
    daily = kept(bt.run_backtest(parts, bt.MovingAverageCrossover(), by=by), "daily")
    return shown(bt.compute_metrics(daily, bt.extract_trades(daily, by), by=by))


@query(sql.EVENT_WINDOWS)
def event_windows(spark, sf_dir):
    return shown(eventstudy.event_windows(walk(spark, sf_dir), quarter_events(spark, sf_dir)))


@query(sql.EVENT_STUDY)
def event_study(spark, sf_dir):
    return shown(eventstudy.study_events(walk(spark, sf_dir), quarter_events(spark, sf_dir)))


@query(sql.EVENT_PATH)
def event_average_path(spark, sf_dir):
    return shown(eventstudy.average_event_path(walk(spark, sf_dir), quarter_events(spark, sf_dir)))


@query(sql.EVENTS_IMPORT)
def events_import(spark, sf_dir):
    mine = cal.typed(quarter_events(spark, sf_dir).withColumn("actual", F.lit(1.0)))
    new = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.min("o_orderdate").cast("date").alias("date"))
    new = new.select("date", F.lit("US").alias("country"), F.lit(cal.EVENT_TYPES[0]).alias("event"), F.lit("2.0").alias("actual"))
    return cal.import_events(mine, new)


@query(sql.EVENTS_LATEST)
def events_latest(spark, sf_dir):
    return cal.of_type(quarter_events(spark, sf_dir), cal.EVENT_TYPES[0])


@query(sql.EVENTS_SEED)
def events_seed(spark, sf_dir):
    """The seeded days with what the orders of these days come to; the seed's and the quarters' days in one calendar."""
    days = cal.import_events(cal.seed_events(spark), quarter_events(spark, sf_dir))
    return days.groupBy("country", "event", F.year("date").alias("year")).agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))


@query(sql.EVENTS_LOG)
def events_log(spark, sf_dir):
    """A calendar as a log in the shared folder: seeded with the quarters' days, stored as one, then months uploaded twice
    and a day added that is there already."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.min("o_orderdate").cast("date").alias("date"), F.max("o_totalprice").alias("actual"))
    months = months.select("date", F.lit("US").alias("country"), F.lit(cal.EVENT_TYPES[0]).alias("event"), F.round("actual", 2).alias("actual"))
    clock = iter(range(1, 100))
    calendar = cal.EventCalendar(spark, f"{shared_folder(spark)}/calendar-{uuid.uuid4().hex}", lambda: next(clock), quarter_events(spark, sf_dir))
    calendar.load()
    calendar.compact()
    calendar.upload(months)
    calendar.upload(months)
    return calendar.add((date(1995, 1, 1), "US", cal.EVENT_TYPES[0], None, 1.0, None))


@query(sql.SNAPSHOTS)
def snapshots(spark, sf_dir):
    """Hourly bars kept as a snapshot: the rows of the second load, which finds it fresh, and of a third, whose source
    fails when the snapshot is old."""
    now = [0.0]
    store = src.SnapshotStore(spark, f"{shared_folder(spark)}/snapshots-{uuid.uuid4().hex}", 12, lambda: now[0])
    path = store.path("ALL", *src.default_dates(end=date(2024, 12, 31)))
    fetch = lambda: src.interval_bars(table(spark, sf_dir, "events"))
    store.get(path, fetch)
    again, fresh = store.get(path, fetch)
    now[0] = 13 * 3600.0
    old, stale = store.get(path, lambda: spark.range(0))
    both = again.withColumn("how", F.lit(fresh)).unionByName(old.withColumn("how", F.lit(stale)))
    return shown(both.groupBy("asset_key", "how").agg(F.count("*").alias("n"), F.max("high").alias("high"), F.sum("volume").alias("volume")))


@query(sql.STORED)
def stored_bars(spark, sf_dir):
    """A bucketed and partitioned table of bars, read for two assets and some years."""
    name = f"bars_{uuid.uuid4().hex}"
    bars = BarTable(spark, name, f"{shared_folder(spark)}/{name}", "year", 8)
    bars.write(walk(spark, sf_dir))
    part = bars.read(["A", "N"], date(1996, 3, 1), date(1998, 10, 31))
    return shown(returns.cumulative_returns(part, block="year"), "asset_key", "date", "close", "cum_ret")


KINDS = (("click", "Click", "CLK", "Flow", "USD", "US", "C"), ("view", "View", "VW", "Flow", "USD", "US", "V"))


@query(sql.LOAD_ASSET)
def load_asset(spark, sf_dir):
    """Two assets loaded from a source by way of a snapshot: where they came from, their counters and their last bar."""
    store = src.SnapshotStore(spark, f"{shared_folder(spark)}/assets-{uuid.uuid4().hex}", 12, lambda: 0.0)
    raw = raw_bars(spark, sf_dir)
    key_of = {k[2]: k[0] for k in KINDS}
    fetch = lambda ticker, start, end, interval: src.in_range(raw, [key_of[ticker]], start, end)
    out = []
    for key in ("click", "view", "click"):
        got = src.load_asset(store, key, fetch, end=date(2024, 12, 31), assets=KINDS)
        last = got.bars.groupBy("asset_key").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("close"))
        out.append(got.report.join(last, "asset_key").withColumns({"from_cache": F.lit(got.from_cache), "stale": F.lit(got.stale)}))
    return shown(out[0].unionByName(out[1]).unionByName(out[2]), day=False)


def crossed(state, bars):
    """Long above the mean of all closes so far; the state is their number and sum."""
    n, total = state or (0, 0.0)
    count = np.arange(n + 1, n + 1 + len(bars))
    sums = total + bars["close"].cumsum()
    return (bars["close"] > sums / count).astype(float), (int(count[-1]), float(sums.iloc[-1]))


@query(sql.STRATEGY)
def strategy_in_chunks(spark, sf_dir):
    """A strategy of the user's own, in chunks of 500 bars."""
    return shown(bt.run_backtest(walk(spark, sf_dir), bt.ChunkedStrategy(crossed, rows_a_chunk=500)), "asset_key", "date", "signal", "position", "equity", digits=4)


@query(sql.TAPE)
def tape(spark, sf_dir):
    return shown(summary.tape(walk(spark, sf_dir, None)))


@query(sql.SPARK)
def sparkline(spark, sf_dir):
    return shown(summary.sparkline(walk(spark, sf_dir, None)))


@query(sql.SNAPSHOT)
def snapshot(spark, sf_dir):
    out = summary.snapshot(walk(spark, sf_dir, None)).withColumns({"n_observations": F.size("observations"), "said": F.array_join("observations", " ")})
    return shown(out.drop("observations"))


@query(sql.OVERVIEW)
def market_overview(spark, sf_dir):
    return shown(summary.market_overview(walk(spark, sf_dir, None)))


@query(sql.STREAM_BARS)
def hourly_bars(spark, sf_dir):
    return shown(src.interval_bars(table(spark, sf_dir, "events")), day=False)


def fractional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with positions between 0 and 1, short ones and missing ones among them."""
    from ..functions.windows import over

    n = F.row_number().over(over()) % 40
    signal = F.when(n < 8, 1.0).when(n < 14, 0.5).when(n < 20, -1.0).when(n < 24, 1.0).when(n == 30, 0.25)
    return walk(spark, sf_dir).withColumn("signal", signal)


@query(sql.TRADES_FRACTIONAL)
def backtest_trades_fractional(spark, sf_dir):
    return shown(bt.extract_trades(bt.run_backtest(fractional(spark, sf_dir), None)))


@query(sql.EXECUTION)
def execution_prices(spark, sf_dir):
    made, costs = bt.extract_trades(bt.run_backtest(walk(spark, sf_dir), bt.MovingAverageCrossover())), bt.CostModel(slippage_bps=25.0)
    paid, got = costs.execution_price(F.col("entry_price"), F.lit(1)), costs.execution_price(F.col("exit_price"), F.lit(-1))
    return shown(made.select("asset_key", "trade_id", paid.alias("paid"), got.alias("got")))


NAMES = (("A", "Alpha", "A.X", "Equity Index", "USD", "US", "A"), ("Z", "Zeta", "Z=F", "Commodity", "USD", "Global", "Z"), ("N", "Nu", "N=X", "FX", "INR", "India", "N"))


@query(sql.OVERVIEW_NAMED)
def market_overview_named(spark, sf_dir):
    return shown(summary.market_overview(walk(spark, sf_dir, None), schema.assets(spark, NAMES)))


@query(sql.CARDS)
def overview_cards(spark, sf_dir):
    return shown(summary.first_cards(summary.market_overview(walk(spark, sf_dir, None), schema.assets(spark, NAMES)), 2).select("asset_key", "name", "price", "ret_1"))


@query(sql.LOOKUP)
def asset_lookup(spark, sf_dir):
    """Parts as assets, their types as classes: those of one class, and all keys, by display order."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("asset_key"), F.col("p_type").alias("asset_class"), F.col("p_partkey").cast("int").alias("display_order"))
    chosen = schema.assets_by_class(parts, "ECONOMY").select("asset_key", F.lit("class").alias("by"))
    return chosen.unionByName(schema.asset_keys(parts).withColumn("by", F.lit("all")))


@query(sql.LOADED)
def load_selected(spark, sf_dir):
    bars, _ = src.usable(raw_bars(spark, sf_dir), ["click", "view", "missing"])
    return shown(bars.select("asset_key", "date", "close", "ret"), day=False)


@query(sql.LOAD_ERRORS)
def load_errors(spark, sf_dir):
    return src.usable(raw_bars(spark, sf_dir), ["click", "view", "missing"])[1]


@query(sql.IN_RANGE)
def bars_of_default_dates(spark, sf_dir):
    rows = src.in_range(src.interval_bars(table(spark, sf_dir, "events")), None, *src.default_dates())
    return shown(rows.groupBy("asset_key").agg(F.count("*").alias("n"), F.min("date").alias("first"), F.max("date").alias("last")), day=False)


@query(sql.PROVIDER)
def provider_columns(spark, sf_dir):
    bars = src.interval_bars(table(spark, sf_dir, "events"))
    named = bars.select("asset_key", F.col("date").alias(" DATE"), F.col("open").alias("Open"), F.col("high").alias("open "), F.col("close").alias("close"), F.col("close").alias("adj close"), F.col("volume").alias("VOLUME"), F.lit(1).alias("Dividends"))
    return shown(clean.normalise_columns(named), day=False)


@query(sql.EVENTS_ADDED)
def events_added(spark, sf_dir):
    mine = cal.typed(quarter_events(spark, sf_dir))
    return cal.add_event(mine, (date(2030, 1, 2), None, "US CPI", 0.2, 0.3, None))


@query(sql.EVENT_KINDS)
def event_types(spark, sf_dir):
    return cal.event_types(table(spark, sf_dir, "events").select(F.col("event_type").alias("event")))


@query(sql.TEXTS)
def formatted_texts(spark, sf_dir):
    rows = walk(spark, sf_dir).withColumn("ret", F.round("ret", 9) + F.lit(0.0))
    gain = F.when(F.dayofmonth("date") == 1, F.lit(float("inf"))).otherwise(F.col("ret") * 7)
    texts = {"change": summary.percent("ret", 2, True), "price": summary.number(F.round(F.col("close") * 100, 6)), "factor": summary.ratio_text(gain), "moved": summary.direction("ret")}
    return rows.withColumns(texts).select("asset_key", F.col("date").cast("date").alias("date"), *texts)


def one_long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of lineitem as the ticks of a single asset: a price a second."""
    second = F.timestamp_seconds(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) + F.col("l_orderkey") % 86400).cast("timestamp_ntz")
    price = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")) / F.sum(F.col("l_quantity").cast("long"))
    ticks = table(spark, sf_dir, "lineitem").groupBy(second.alias("date")).agg(price.alias("close"))
    return ticks.select(F.lit("ALL").alias("asset_key"), "date", "close", F.col("close").alias("adj_close"))


@query(sql.LONG_SERIES)
def long_series(spark, sf_dir):
    """One asset has all the rows: its frames, running and weighted means are cut by month."""
    df = returns.daily_returns(one_long_series(spark, sf_dir), block="month")
    df = drawdown.drawdown_series(returns.cumulative_returns(df, block="month"), block="month")
    df = indicators.ema(indicators.with_sma(df, {"sma_200": 200}, block="month"), 20, block="month")
    return shown(df, "date", "cum_ret", "peak", "drawdown", "sma_200", "ema", day=False, digits=4)


@query(sql.ASOF)
def asof_orders(spark, sf_dir):
    """Each event with its user's orders around it: the last before, the first after, the nearest within six hours. Order
    days become times in the month of the events."""
    from datetime import timedelta

    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    at = F.timestamp_seconds(F.lit(1704067200) + day * 1080).cast("timestamp_ntz")
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), at.alias("at"), "o_orderkey")
    ticks = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    how = {"by": ["user_id"], "left_time": "ts", "right_time": "at", "block": "day"}
    met = asof(ticks, orders, out="prior", **how)
    met = asof(met, orders, direction="forward", exact=False, out="next", **how)
    met = asof(met, orders, direction="nearest", tolerance=timedelta(hours=6), out="near", **how)
    return met.select("event_id", *(F.col(f"{c}.o_orderkey").alias(c) for c in ("prior", "next", "near")))


@query(sql.CORR_WIDE)
def correlation_wide(spark, sf_dir):
    """Every supplier is an asset: weekly discounts, hundreds of thousands of pairs at larger scales."""
    week = F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("date")
    weekly = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("asset_key"), week).agg(F.sum(F.round(F.col("l_discount") * 100)).alias("ret"))
    found = correlation.correlation_matrix(weekly)
    # as `shown`, without a decimal number for each of so many rows
    return found.select("a", "b", (F.signum("corr") * F.floor(F.abs("corr") * 1e6 + 0.5) / 1e6 + F.lit(0.0)).alias("corr"), "n")
