"""Closed forms, edge cases and differential tests of the analytics."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.functions.recursive import ewm
from barograph.functions.windows import correlation as corr_of
from barograph.operators import backtest as bt
from barograph.operators import clean, correlation, drawdown, eventstudy, indicators, regime, returns, summary, volatility
from barograph import schema
from barograph.schema import DataUnavailableError, DataValidationError
from barograph.sources import bars as src
from barograph.sources import events as cal
from barograph.streaming import bars as streaming
from barograph.streaming.indicators import stream_ema

near = lambda x: pytest.approx(x, rel=1e-9, abs=1e-9)
RNG = np.random.default_rng(3)
WALK = (100 * np.exp(np.cumsum(RNG.normal(0, 0.01, 700)))).tolist()


def one(df):
    return df.collect()[0]


# returns


def test_returns_and_growth(bars, values):
    df = returns.daily_returns(bars([100, 110, 99]))
    assert values(df, "ret") == [None, near(0.1), near(-0.1)]
    assert values(returns.cumulative_returns(df), "cum_ret") == [0.0, near(0.1), near(-0.01)]
    assert one(returns.period_return(bars([1, 2, 4]), 2))["ret"] == near(3)
    assert one(returns.period_return(bars([1, 2, 4]), 3))["ret"] is None
    assert one(returns.total_return_cagr(bars(np.linspace(100, 200, 253))))["cagr"] == near(1.0)
    assert one(returns.total_return_cagr(bars([5])))["total_return"] is None
    by_ret = one(returns.cagr_from_returns(returns.daily_returns(bars(WALK))))["cagr"]
    assert by_ret == near(one(returns.total_return_cagr(bars(WALK)))["cagr"])


def test_ytd_bases(spark):
    rows = [("X", dt.datetime(2022, 12, 30), 100.0), ("X", dt.datetime(2023, 1, 3), 101.0), ("X", dt.datetime(2023, 6, 1), 110.0), ("Y", dt.datetime(2023, 1, 3), 50.0), ("Y", dt.datetime(2023, 2, 1), 60.0), ("Z", dt.datetime(2023, 2, 1), 60.0)]
    out = {r["asset_key"]: r["ret_ytd"] for r in returns.ytd_return(spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, adj_close double")).collect()}
    assert out == {"X": near(0.1), "Y": near(0.2), "Z": None}


def test_resample_fills_empty_bins(spark):
    rows = [("X", dt.datetime(2020, 1, 10), 0.1), ("X", dt.datetime(2020, 1, 20), 0.1), ("X", dt.datetime(2020, 3, 5), None), ("X", dt.datetime(2020, 4, 1), -0.5)]
    df = spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, ret double")
    out = [(r["period"], r["ret"]) for r in returns.resample_returns(df, "ME").orderBy("period").collect()]
    assert out == [(dt.date(2020, 1, 31), near(0.21)), (dt.date(2020, 2, 29), 0.0), (dt.date(2020, 3, 31), 0.0), (dt.date(2020, 4, 30), near(-0.5))]
    weeks = [r["period"] for r in returns.resample_returns(df, "W").orderBy("period").collect()]
    assert weeks[0] == dt.date(2020, 1, 12) and all(w.weekday() == 6 for w in weeks) and len(weeks) == 13


# cleaning


def test_cleaning_steps(spark):
    day = lambda i: dt.datetime(2020, 1, i)
    rows = [
        ("X", day(1), "10", "11", "9", "10", None, 1), ("X", day(2), "10", "5", "9", "10", "7", 1), ("X", day(3), None, "12", "9", "11", "7", 1),
        ("X", day(3), None, "12", "9", "10.5", "7", 2), ("X", None, "1", "1", "1", "1", "7", 1), ("X", day(4), "1", "2", "1", "oops", "7", 1), ("Y", day(1), "0", "1", "1", "1", "7", 1),
    ]
    raw = spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, open string, high string, low string, close string, volume string, ingest_seq int")
    out = clean.clean_bars(raw).orderBy("date").collect()
    assert [(r["date"], r["open"], r["close"], r["adj_close"], r["volume"]) for r in out] == [(day(1), 10, 10, 10, 0), (day(3), 10, 10.5, 10.5, 7)]
    report = {r["asset_key"]: r.asDict() for r in clean.cleaning_report(raw).collect()}
    assert report["X"] == {"asset_key": "X", "rows_in": 6, "rows_out": 2, "duplicates_removed": 1, "missing_filled": 1, "invalid_ohlc_rows": 1}
    assert [r["asset_key"] for r in clean.rejected_assets(raw).collect()] == ["Y"]


def test_cleaning_names_and_errors(spark):
    df = spark.createDataFrame([("X", "2020-01-01", 1.0, 2.0)], "asset_key string, ` date ` string, CLOSE double, `adj close` double")
    assert clean.normalise_columns(df).columns == ["asset_key", "date", "close", "adj_close"]
    with pytest.raises(DataValidationError):
        clean.clean_bars(spark.createDataFrame([("X",)], "asset_key string"))
    assert clean.file_key("^GSPC=F/a.b") == "IDX_GSPC_F_a_b"


def test_returns_pad_missing_prices(bars, values):
    assert values(clean.add_returns(bars([100, None, 110])), "ret") == [None, 0.0, near(0.1)]
    assert values(clean.add_returns(bars([100, None, 110]), fill=False), "ret") == [None, None, None]


# volatility, drawdown, regimes, trends


def test_volatility_against_pandas(bars, values):
    df = returns.daily_returns(bars(WALK))
    want = pd.Series(WALK).pct_change(fill_method=None).rolling(20).std() * math.sqrt(252)
    got = values(df.withColumn("v", volatility.rolling_volatility(20)), "v")
    assert [x is None for x in got] == want.isna().tolist()
    np.testing.assert_allclose([x for x in got if x is not None], want.dropna(), rtol=1e-9)
    assert one(volatility.realized_volatility(df, 20))["vol"] == near(want.iloc[-1])
    assert one(volatility.realized_volatility(df, 5000))["vol"] is None


def test_drawdown_dates(bars):
    r = one(drawdown.max_drawdown_stats(bars([100, 120, 90, 60, 80, 130])))
    assert r["max_drawdown"] == near(-0.5) and r["recovered"] and r["current_drawdown"] == 0
    assert [r[c].day for c in ("peak_date", "trough_date", "recovery_date")] == [2, 6, 8]
    r = one(drawdown.max_drawdown_stats(bars([100, 150, 120, 110])))
    assert r["max_drawdown"] == near(110 / 150 - 1) and r["recovery_date"] is None and not r["recovered"]
    assert one(drawdown.max_drawdown_stats(bars([1, 2, 3])))["recovered"]


def test_regimes(bars):
    noisy = np.concatenate([RNG.normal(0, 0.005, 300), RNG.normal(0, 0.03, 300)])
    df = returns.daily_returns(bars(100 * np.exp(np.cumsum(noisy))))
    rows = regime.regime_series(df).orderBy("date").collect()
    vol = (df.toPandas().sort_values("date")["ret"].astype(float).rolling(20).std() * math.sqrt(252)).dropna()
    low = vol.expanding(20).quantile(0.33)
    assert [r["regime"] for r in rows[:19]] == ["Normal"] * 19
    np.testing.assert_allclose([r["low_threshold"] for r in rows[19:]], low.dropna(), rtol=1e-9)
    shares = regime.performance_by_regime(df).collect()
    assert sum(r["share"] for r in shares) == near(1.0) and {r["regime"] for r in shares} <= {"Low", "Normal", "High"}
    assert one(regime.current_regime(returns.daily_returns(bars([1, 2]))))["regime"] == "Unknown"
    assert one(regime.current_trend(bars(np.linspace(1, 2, 250))))["trend"] == "Bullish"
    assert one(regime.current_trend(bars(np.linspace(2, 1, 250))))["trend"] == "Bearish"
    assert one(regime.current_trend(bars([1, 2])))["trend"] == "Neutral"


# correlation


def test_correlations_against_pandas(bars):
    a, b = RNG.normal(0, 1, 200), RNG.normal(0, 1, 200)
    b = np.where(RNG.random(200) < 0.1, np.nan, np.round(a + b, 1))
    df = bars({"A": a, "B": [None if np.isnan(x) else x for x in b]}).withColumnRenamed("close", "ret")
    wide = pd.DataFrame({"A": a, "B": b})
    for method in ("pearson", "spearman", "kendall"):
        got = {(r["a"], r["b"]): r["corr"] for r in correlation.correlation_matrix(df, method=method).collect()}
        both = wide.dropna()
        want = both.corr().iloc[0, 1] if method == "pearson" else both.rank().corr().iloc[0, 1] if method == "spearman" else None
        if want is None:
            x, y = both["A"].to_numpy(), both["B"].to_numpy()
            sx, sy = (np.sign(v[:, None] - v[None, :]) for v in (x, y))
            want = (sx * sy).sum() / math.sqrt((sx**2).sum() * (sy**2).sum())
        assert got[("A", "B")] == near(want) == got[("B", "A")] and got[("A", "A")] == 1
    with pytest.raises(ValueError):
        correlation.correlation_matrix(df, method="cosine")


def test_rolling_correlation_and_zero_variance(spark, bars, values):
    a, b = RNG.normal(0, 1, 200), RNG.normal(0, 1, 200)
    df = bars({"A": a, "B": b}).withColumnRenamed("close", "ret")
    got = values(correlation.rolling_correlation(df, "A", "B", 60), "corr")
    want = pd.Series(a).rolling(60).corr(pd.Series(b))
    assert got[:59] == [None] * 59
    np.testing.assert_allclose(got[59:], want[59:], rtol=1e-8, atol=1e-12)
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert one(flat.agg(corr_of("x", "y").alias("c")))["c"] is None


def test_missing_days_in_comparisons(bars):
    df = returns.daily_returns(bars({"A": [1, 2, 4, 8], "B": [1, None, 3, 6]}).filter("close is not null"))
    assert correlation.comparative_returns(df).count() == 4  # the day that B lacks, and the first, go
    kept = {(r["asset_key"], r["date"].day): r["cum_ret"] for r in correlation.normalised_prices(df).collect()}
    assert len(kept) == 6 and kept[("B", 2)] == 0 and kept[("B", 6)] == near(5)


# indicators


@pytest.mark.parametrize("alpha,least", [(2 / 13, 1), (1 / 14, 14), (2 / 51, 50), (2 / 3, 2), (0.9, 1), (1.0, 1)])
def test_ewm_over_many_blocks(spark, alpha, least):
    x = [None, None, *RNG.normal(50, 5, 6000).tolist()]
    df = spark.createDataFrame([("X", i, v) for i, v in enumerate(x)], "asset_key string, date int, x double")
    got = [r["y"] for r in ewm(df, "x", alpha, "y", least).orderBy("date").collect()]
    want = pd.Series(x, dtype=float).ewm(alpha=alpha, adjust=False, min_periods=least).mean()
    assert [g is None for g in got] == want.isna().tolist()
    np.testing.assert_allclose([g for g in got if g is not None], want.dropna(), rtol=1e-12)


def test_indicators(bars, values):
    df = bars([1, 2, 3, 4, 5])
    assert values(df.withColumn("s", indicators.sma(3)), "s") == [None, None, 2, 3, 4]
    assert values(indicators.ema(df, 3), "ema") == [None, None, near(2.25), near(3.125), near(4.0625)]
    up = values(indicators.rsi(bars(np.arange(1, 40))), "rsi")
    assert up[:14] == [None] * 14 and up[14:] == [100] * 25
    assert all(x < 0.1 for x in values(indicators.rsi(bars(np.arange(40, 1, -1))), "rsi")[14:])
    assert set(values(indicators.rsi(bars([5] * 30)), "rsi")[14:]) == {50}
    assert max(abs(x) for x in values(indicators.macd(bars([50.0] * 100)), "macd_histogram")) < 1e-12
    m = indicators.macd(bars(WALK)).collect()
    assert all(abs(r["macd"] - r["macd_signal"] - r["macd_histogram"]) < 1e-12 for r in m)
    b = indicators.bollinger(bars(WALK)).orderBy("date").collect()[-1]
    tail = np.array(WALK[-20:])
    assert b["bb_upper"] == near(tail.mean() + 2 * tail.std()) and b["bb_width"] == near(4 * tail.std() / tail.mean())
    tr = bars([9, 11], high=[10.0, 12.0], low=[8.0, 9.0])
    assert values(indicators.atr(tr, 2), "true_range") == [2, 3] and values(indicators.atr(tr, 2), "atr") == [None, near(2.5)]


# strategies and backtests


def loop_latch(rsi, entry, leave):
    on, out = 0.0, []
    for x in rsi:
        if x is None:
            out.append(0.0)
            continue
        on = 1.0 if x < entry else 0.0 if x > leave else on
        out.append(on)
    return out


def test_signals(bars, values):
    with pytest.raises(ValueError):
        bt.MovingAverageCrossover(50, 50)
    with pytest.raises(ValueError):
        bt.RSIMeanReversion(14, 50, 50)
    v = [*np.linspace(100, 60, 40), *np.linspace(60, 140, 60)]
    for prices in (v, WALK):
        df = bars(prices)
        s = bt.RSIMeanReversion()
        assert values(s.signal(df), "signal") == loop_latch(values(indicators.rsi(df), "rsi"), 30, 50)
    assert 1.0 in values(bt.RSIMeanReversion().signal(bars(v)), "signal")
    own = bt.PandasStrategy(lambda d: d["close"] > d["close"].rolling(5).mean())
    got = values(own.signal(bars(WALK)), "signal")
    assert got == (pd.Series(WALK) > pd.Series(WALK).rolling(5).mean()).astype(float).tolist()


def test_no_look_ahead(bars, values):
    df = bars([100] * 5 + [200] * 5, signal=[0.0] * 5 + [1.0] * 5)
    daily = bt.run_backtest(df, None)
    assert values(daily, "position") == [0] * 6 + [1] * 4
    assert values(daily, "gross_equity")[-1] == near(100_000)


def test_backtest_against_loop(bars):
    df = bars(WALK, signal=(RNG.random(700) < 0.5).astype(float).tolist())
    rows = bt.run_backtest(df, None).orderBy("date").collect()
    equity, before, open_at, trades, ret = 100_000.0, 0.0, None, [], 1.0
    signal = [r["signal"] for r in rows]
    for i, r in enumerate(rows):
        pos = signal[i - 1] if i else 0.0
        net = pos * (WALK[i] / WALK[i - 1] - 1 if i else 0.0) - abs(pos - before) * 0.0007
        equity *= 1 + net
        assert r["equity"] == near(equity) and r["position"] == pos
        if pos and not before:
            open_at, ret = i, 1.0
        if open_at is not None:
            ret *= 1 + net
            if not pos or i == len(rows) - 1:
                trades.append((open_at, i, ret - 1))
                open_at = None
        before = pos
    got = bt.extract_trades(bt.run_backtest(df, None)).orderBy("entry_date").collect()
    assert [(r["bars_held"], r["ret"]) for r in got] == [(b - a, near(x)) for a, b, x in trades]


def test_costs_metrics_and_tables(spark, bars):
    always = bars(WALK, signal=[1.0] * 700)
    free, dear = (bt.run_backtest(always, None, costs=c) for c in (bt.CostModel(0, 0), bt.CostModel(50, 0)))
    last = lambda d, c: d.orderBy(F.col("date").desc()).first()[c]
    assert last(free, "equity") == near(100_000 * WALK[-1] / WALK[0]) and last(dear, "equity") < last(free, "equity")
    assert bt.CostModel().fraction == near(0.0007)
    bundle = bt.metrics_bundle(dear)
    rows = {r["kind"]: r for r in bundle.collect()}
    assert rows["gross"]["total_return"] > rows["net"]["total_return"] and rows["benchmark"]["num_trades"] == 1
    assert bt.metrics_table(bundle).count() == 9
    stats = one(bt.trade_stats(spark.createDataFrame([("X", r) for r in (0.1, -0.05, 0.2, -0.1, None)], "asset_key string, ret double")))
    assert (stats["num_trades"], stats["win_rate"], stats["profit_factor"]) == (4, 0.5, near(2.0))
    only_won = one(bt.trade_stats(spark.createDataFrame([("X", 0.1)], "asset_key string, ret double")))
    assert only_won["profit_factor"] == math.inf
    flat = bt.run_backtest(bars([1.0] * 300, signal=[1.0] * 300), None, costs=bt.CostModel(0, 0))
    assert one(bt.compute_metrics(flat, bt.extract_trades(flat)))["sharpe"] is None


def test_out_of_sample_segments_start_anew(bars):
    split = bt.split_dev_oos(bars(WALK), (dt.date(2020, 1, 1), dt.date(2020, 12, 31)), (dt.date(2021, 1, 1), dt.date(2021, 12, 31)))
    daily = bt.run_backtest(split, bt.MovingAverageCrossover(5, 20), by=["asset_key", "segment"])
    firsts = daily.groupBy("segment").agg(F.min_by("equity", "date").alias("e"), F.min_by("position", "date").alias("p")).collect()
    assert len(firsts) == 2 and all((r["e"], r["p"]) == (100_000, 0) for r in firsts)


# events


def test_event_windows(spark, bars):
    df = bars({"A": np.linspace(100, 140, 40), "B": np.linspace(200, 180, 40)})
    days = [r["date"] for r in df.filter("asset_key = 'A'").orderBy("date").collect()]
    events = spark.createDataFrame([(days[20].date(),), (dt.date(2019, 1, 1),), (dt.date(2030, 1, 1),)], "date date")
    rows = eventstudy.event_windows(df, events).collect()
    mid = sorted((r for r in rows if r["asset_key"] == "A" and r["event_date"] == days[20]), key=lambda r: r["offset"])
    assert [r["offset"] for r in mid] == list(range(-5, 6)) and mid[5]["cum_ret"] == 0 and mid[0]["ret"] is None
    late = [r["offset"] for r in rows if r["asset_key"] == "A" and r["event_date"].year == 2030]
    assert sorted(late) == list(range(-5, 1)) and not any(r["event_date"].year == 2019 for r in rows)
    study = {r["asset_key"]: r for r in eventstudy.study_events(df, events).collect() if r["event_date"] == days[20]}
    assert study["A"]["price_move"] > 0 > study["B"]["price_move"]
    p = np.linspace(100, 140, 40)
    assert study["A"]["ret_pre"] == near(p[19] / p[15] - 1) and study["A"]["ret_post"] == near(p[25] / p[20] - 1)
    short = [r for r in eventstudy.study_events(df, events, pre=1).collect() if r["event_date"] == days[20]][0]
    assert short["ret_pre"] == 0 and short["vol_pre"] is None
    path = eventstudy.average_event_path(df, events).filter("asset_key = 'A' and offset = 0").collect()[0]
    assert (path["mean_cum_ret"], path["n_events"]) == (0, 2)


def test_event_calendar(spark, tmp_path):
    seed = cal.seed_events(spark)
    assert seed.count() == 28
    path = f"file://{tmp_path}/events"
    cal.write_events(cal.add_event(seed, (dt.date(2026, 1, 2), None, "US CPI", 1.0, 2.0, 3.0)), path)
    back = cal.read_events(spark, path)
    assert back.count() == 29 and back.filter("actual = 2").count() == 1
    new = spark.createDataFrame([("2026-01-02", "US CPI", "9"), ("bad", "US CPI", "9"), ("2026-02-01", "US CPI", "x")], "date string, event string, actual string")
    merged = cal.import_events(back, new)
    assert merged.count() == 30 and merged.filter("actual = 9").count() == 0
    assert cal.import_events(back, new, replace=True).count() == 2
    assert [r["event"] for r in cal.event_types(merged).collect()] == ["Fed Rate Decision", "US CPI"]
    assert cal.of_type(merged, "US CPI").first()["date"] == dt.date(2026, 2, 1)
    with pytest.raises(DataValidationError):
        cal.typed(spark.createDataFrame([("x",)], "event string"))


# summaries, sources, streaming


def test_summaries(spark, bars):
    df = bars({"A": WALK, "B": WALK[::-1]})
    rows = {r["asset_key"]: r for r in summary.snapshot(df).collect()}
    assert all(len(r["observations"]) == 5 for r in rows.values())
    assert {r["asset_key"]: r["last"] for r in summary.tape(df).collect()} == {"A": near(WALK[-1]), "B": near(WALK[0])}
    line = summary.sparkline(df).filter("asset_key = 'A'").collect()
    assert min(r["y"] for r in line) == 0 and max(r["y"] for r in line) == 64 and max(r["x"] for r in line) == 260
    text = spark.createDataFrame([(0.1234, float("inf")), (None, 1234.5)], "x double, y double").select(summary.percent("x", signed=True).alias("p"), summary.ratio_text("y").alias("r"), summary.number("y").alias("n"), summary.direction("x").alias("d")).collect()
    assert [tuple(r) for r in text] == [("+12.34%", "∞", "—", "up"), ("—", "1234.50", "1,234.50", "flat")]


def test_sources(spark, bars, tmp_path):
    path = f"file://{tmp_path}/bars"
    bars({"A": WALK, "B": WALK}).write.parquet(path)
    got, errors = src.load_many(spark, path, ["A", "C"], dt.date(2020, 1, 1), dt.date(2020, 1, 10))
    assert got.count() == 8 and "ret" in got.columns and [r["asset_key"] for r in errors.collect()] == ["C"]
    with pytest.raises(DataUnavailableError):
        src.load_many(spark, path, ["Q"])


def test_snapshot_store(spark, bars, tmp_path):
    now = [0.0]
    store = src.SnapshotStore(spark, f"file://{tmp_path}/snap", 12, lambda: now[0])
    path = store.path("^X", dt.date(2020, 1, 1), dt.date(2020, 2, 1))

    def broken():
        raise OSError("offline")

    with pytest.raises(OSError):
        store.get(path, broken)
    assert store.get(path, lambda: bars([1, 2]))[1] == "fetched"
    assert store.get(path, broken)[1] == "fresh"
    now[0] = 13 * 3600.0
    assert store.get(path, broken)[1] == "stale" and store.get(path, lambda: bars([1, 2]).limit(0))[1] == "stale"


def test_streamed_bars_equal_batch(spark, sf_dir, tmp_path):
    ticks = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", "ts", "value")
    ticks.repartition(4).sortWithinPartitions("ts").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(ticks.schema).parquet(f"file://{tmp_path}/in")
    streaming.write_bars(streaming.stream_bars(stream, late="60 days"), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    done = spark.read.parquet(f"file://{tmp_path}/out")
    batch = streaming.stream_bars(ticks)
    assert done.exceptAll(batch).count() == 0


def test_streamed_ema_equals_batch(spark, bars, tmp_path):
    df = bars({"A": WALK[:60], "B": WALK[100:160]}).select("asset_key", F.col("date").cast("timestamp").alias("date"), "close")
    days = [r["date"] for r in df.select("date").distinct().orderBy("date").collect()]
    for k in range(3):  # a file a batch; the last repeats ten days
        part = df.filter(F.col("date").between(days[max(0, 20 * k - 10 * (k == 2))], days[20 * k + 19]))
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    streaming.write_bars(stream_ema(stream, 5), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = {(r["asset_key"], r["date"]): r["ema"] for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {(r["asset_key"], r["date"]): r["ema"] for r in indicators.ema(df, 5, "close").collect()}
    assert got.keys() == want.keys() and all(got[k] == (None if want[k] is None else near(want[k])) for k in want)


def test_asset_dimension(spark, bars):
    dimension = schema.assets(spark)
    assert [r["asset_key"] for r in schema.asset_keys(dimension).collect()][:2] == ["SP500", "NASDAQ100"]
    assert schema.assets_by_class(dimension, "Commodity").count() == 2
    rows = {r["asset_key"]: r for r in summary.market_overview(bars({"GOLD": WALK, "X": [None, 1, 2]}), dimension).collect()}
    assert rows["GOLD"]["name"] == "Gold" and rows["X"]["name"] == "X" and rows["X"]["regime"] == "Unknown" and rows["X"]["ret_1"] == near(1)


def test_calendar_store(spark, tmp_path):
    store = cal.EventCalendar(spark, f"file://{tmp_path}/calendar")
    assert store.load().count() == 28
    assert store.add((dt.date(2026, 1, 2), "US", "US CPI", None, None, None)).count() == 29
    assert store.upload(spark.createDataFrame([("2026-01-02", "US", "US CPI")], "date string, country string, event string")).count() == 29


def test_one_exchange_of_bars_in_overviews(spark, sf_dir):
    from barograph.plans import catalogue

    for name in ("market_overview", "snapshot"):
        plan = catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(asset_key") == 1, name  # windows and aggregates share it
        assert "FlatMapGroupsIn" not in plan, name


def test_overview_plan_has_few_shuffles_of_bars(spark, sf_dir):
    from barograph.plans import catalogue

    plan = regime.trend_series(catalogue.walk(spark, sf_dir, None), block=None)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(asset_key") == 1


def test_fractional_positions_neither_open_nor_close_trades(bars):
    df = bars([100, 101, 103, 102, 104, 105, 107, 106], signal=[1.0, 0.5, 1.0, 0.0, 0.0, -1.0, 0.5, 1.0])
    got = bt.extract_trades(bt.run_backtest(df, None)).collect()
    assert [(r["entry_price"], r["exit_price"], r["bars_held"]) for r in got] == [(101, 104, 3)]


def test_average_trade(spark):
    stats = one(bt.trade_stats(spark.createDataFrame([("X", r) for r in (0.1, -0.05, 0.2, -0.1, None)], "asset_key string, ret double")))
    assert stats["avg_trade_return"] == near(0.0375)


def test_load_asset_and_cleared_snapshots(spark, bars, tmp_path):
    now, root = [0.0], f"file://{tmp_path}/snap"
    store = src.SnapshotStore(spark, root, 12, lambda: now[0])
    raw = bars(WALK[:30]).drop("asset_key")
    fetch = lambda ticker, start, end, interval: raw
    with pytest.raises(KeyError):
        src.load_asset(store, "NOPE", fetch)

    def broken(*a):
        raise OSError("offline")

    with pytest.raises(DataUnavailableError):
        src.load_asset(store, "GOLD", broken)
    days = dt.date(2020, 1, 1), dt.date(2020, 3, 1)
    first = src.load_asset(store, "GOLD", fetch, *days)
    assert (first.from_cache, first.stale, first.asset["ticker"]) == (False, False, "GC=F") and first.bars.count() == 30
    assert {r["asset_key"] for r in first.bars.collect()} == {"GOLD"} and first.report.first()["rows_out"] == 30
    again = src.load_asset(store, "GOLD", broken, *days)
    assert (again.from_cache, again.stale) == (True, False)
    now[0] = 13 * 3600.0
    old = src.load_asset(store, "GOLD", broken, *days)
    assert (old.from_cache, old.stale) == (True, True)
    with pytest.raises(DataUnavailableError):
        src.load_asset(store, "CRUDE", lambda *a: raw.withColumn("close", F.lit(None).cast("double")), *days)
    assert store.clear() > 0 and store.clear() == 0
    with pytest.raises(DataUnavailableError):
        src.load_asset(store, "GOLD", broken, *days)
    store.save = broken
    kept = src.load_asset(store, "GOLD", fetch, *days)
    assert kept.bars.count() == 30 and not kept.from_cache


def test_kendall_by_brute_force(spark):
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    rows = [(k, dt.datetime(2020, 1, 1) + dt.timedelta(i), float(v[i])) for k, v in (("A", x), ("B", y)) for i in range(150)]
    got = correlation.correlation_matrix(spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, ret double"), method="kendall").filter("a = 'A' and b = 'B'").first()
    sx, sy = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    assert got["n"] == 150 and got["corr"] == near((sx * sy).sum() / np.sqrt((sx**2).sum() * (sy**2).sum()))
