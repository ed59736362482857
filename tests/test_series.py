"""Series cut into blocks give what plain windows give, and no task has more than a block."""

import datetime as dt
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.functions.recursive import ewm
from barograph.functions.series import framed, running, with_halo
from barograph.operators import backtest as bt
from barograph.operators import clean, correlation, drawdown, eventstudy, gram, indicators, regime, returns, volatility
from barograph.operators.asof import asof
from barograph.plans import catalogue


@pytest.fixture(scope="module")
def hot(spark):
    """HOT has most bars; days are missing, whole months too, and prices and returns have holes."""
    rng, rows = np.random.default_rng(5), []
    for key, n in (("HOT", 900), ("B", 60), ("C", 1)):
        day, price = dt.datetime(2019, 11, 20), 100.0
        for i in range(n):
            day += dt.timedelta(days=1 + int(rng.random() < 0.2) + 70 * int(rng.random() < 0.01))
            price *= 1 + rng.normal() / 50
            p = None if rng.random() < 0.05 and i else price
            rows.append((key, day, p, p, price * 1.01, price * 0.99, None if rng.random() < 0.05 else float(rng.normal() / 50)))
    return spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, close double, adj_close double, high double, low double, ret double").cache()


CASES = {
    "cumulative": lambda d, b: returns.cumulative_returns(d, block=b),
    "daily": lambda d, b: returns.daily_returns(d, block=b),
    "add_returns": lambda d, b: clean.add_returns(d.drop("ret"), block=b),
    "lag_returns": lambda d, b: clean.add_returns(d.drop("ret"), fill=False, block=b),
    "drawdown": lambda d, b: drawdown.drawdown_series(d, block=b),
    "drawdown_from_returns": lambda d, b: drawdown.drawdown_from_returns(d, block=b),
    "wild_returns": lambda d, b: drawdown.drawdown_from_returns(d.withColumn("ret", F.col("ret") * 90), block=b),
    "stats": lambda d, b: drawdown.max_drawdown_stats(d, block=b).withColumn("date", F.lit(0)),
    "moving": lambda d, b: indicators.moving_averages(d, block=b),
    "rsi": lambda d, b: indicators.rsi(d, block=b),
    "macd": lambda d, b: indicators.macd(d, block=b),
    "bollinger": lambda d, b: indicators.bollinger(d, block=b),
    "atr": lambda d, b: indicators.atr(d, block=b),
    "last": lambda d, b: ewm(d, "close", 1.0, "y", 3, block=b),
    "volatility": lambda d, b: volatility.volatility_frame(d, block=b),
    "trend": lambda d, b: regime.trend_series(d, fast=5, slow=60, block=b),
    "backtest": lambda d, b: bt.run_backtest(d, bt.MovingAverageCrossover(3, 40), block=b),
    "backtest_rsi": lambda d, b: bt.run_backtest(d, bt.RSIMeanReversion(), block=b),
    "trades": lambda d, b: bt.extract_trades(bt.run_backtest(d, bt.MovingAverageCrossover(3, 10), block=b), block=b).withColumn("date", F.col("trade_id")),
    "kinds": lambda d, b: running(d, {"a": ("sum", "ret"), "b": ("count", "close"), "c": ("min", "close"), "d": ("before", "close"), "e": ("lag", "close"), "f": ("product", F.col("ret") * 30)}, block=b),
}


@pytest.mark.parametrize("name", CASES)
def test_blocks_equal_plain_windows(hot, name):
    block = "week" if name in ("moving", "drawdown_from_returns", "backtest", "kinds", "last") else "month"
    a, b = ([tuple(r) for r in CASES[name](hot, how).orderBy("asset_key", "date").collect()] for how in (block, None))
    columns = [CASES[name](hot, how).columns for how in (block, None)]
    assert columns[0] == columns[1] and len(a) == len(b) > 2
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 1e-9 * max(1, abs(q))) for p, q in zip(x, y, strict=True)), (x, y)


def test_halo_copies_just_the_rows_before_a_block(hot):
    rows = [r for r in with_halo(hot, 30, block="month").collect() if r["asset_key"] == "HOT"]
    days = sorted(r["date"] for r in rows if not r["_halo"])
    assert len(days) == 900
    for block in {r["_block"] for r in rows}:
        first = min(r["date"] for r in rows if r["_block"] == block and not r["_halo"])
        before = days[: days.index(first)][-30:]
        assert sorted(r["date"] for r in rows if r["_block"] == block and r["_halo"]) == before


def windows_by_date(df):
    """The partition keys of the plan's windows that are ordered by date."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [re.findall(r"(\w+)#", m) for m in re.findall(r"windowspecdefinition\(([^()]*?), date#", plan)]


@pytest.mark.parametrize("name", [n for n in CASES if n not in ("stats",)])
def test_no_window_has_a_whole_asset(hot, name):
    found = windows_by_date(CASES[name](hot, "month"))
    assert found and all("_block" in keys for keys in found), found


def test_frames_of_one_asset_lie_in_many_tasks(spark, hot):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = framed(hot.filter("asset_key = 'HOT'"), 199, lambda d, keys: d.withColumn("y", indicators.sma(200, "close", keys)), block="month")
        assert made.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


@pytest.mark.parametrize("block", ["month", "week", "year"])
def test_expanding_quantiles_equal_pandas(spark, block):
    rng = np.random.default_rng(11)
    kinds = {"smooth": rng.normal(size=400), "ties": rng.integers(0, 3, 400).astype(float), "flat": np.ones(400), "trend": np.arange(400.0), "falling": -np.arange(400.0) ** 2}
    rows, want = [], {}
    for key, x in kinds.items():
        x = np.where(rng.random(400) < 0.1, np.nan, x)
        rows += [(key, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for i, v in enumerate(x)]
        known = pd.Series(x).dropna()
        for name, q in (("lo", 0.33), ("hi", 0.66), ("top", 1.0), ("zero", 0.0)):
            want |= {(key, i, name): v for i, v in known.expanding(20).quantile(q).items()}
    df = spark.createDataFrame(rows, "asset_key string, date timestamp_ntz, x double")
    for r in regime.expanding_quantiles(df, "x", {"lo": 0.33, "hi": 0.66, "top": 1.0, "zero": 0.0}, 20, block=block, cells=8).collect():
        i = (r["date"] - dt.datetime(2020, 1, 1)).days
        for name in ("lo", "hi", "top", "zero"):
            w = want.get((r["asset_key"], i, name), float("nan"))
            assert (r[name] is None) == bool(np.isnan(w)) and (r[name] is None or abs(r[name] - w) < 1e-9), (r, w)


def test_regimes_need_no_python(spark, sf_dir):
    assert not re.search("Python|Pandas|Arrow", regime.with_regime(catalogue.walk(spark, sf_dir))._jdf.queryExecution().toString())


def ticks(spark, rng, n, name):
    start = dt.datetime(2024, 1, 30)
    rows = [(None if rng.random() < 0.05 else int(rng.choice([1, 1, 1, 1, 2, 3])), None if rng.random() < 0.05 else start + dt.timedelta(minutes=int(rng.integers(0, 8000))), i) for i in range(n)]
    return spark.createDataFrame(rows, f"k long, t timestamp_ntz, {name} long"), rows


@pytest.mark.parametrize("direction", ["backward", "forward", "nearest"])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("minutes", [None, 30])
def test_asof_equals_brute_force(spark, direction, exact, minutes):
    rng = np.random.default_rng(3)
    (left, a), (right, b) = ticks(spark, rng, 300, "i"), ticks(spark, rng, 300, "j")
    got = {r["i"]: None if r["match"] is None else r["match"]["j"] for r in asof(left, right, ["k"], "t", "t", direction, minutes and dt.timedelta(minutes=minutes), exact, block="day").collect()}
    assert len(got) == len(a)
    for k, t, i in a:
        near = [(abs((u - t).total_seconds()), u > t, -(u - t).total_seconds(), -j, j) for q, u, j in b if k is not None and q == k and t and u and (exact or u != t)]
        near = [x for x in near if (minutes is None or x[0] <= 60 * minutes)]
        if direction != "nearest":
            near = [x for x in near if x[0] == 0 or x[1] == (direction == "forward")]
        want = min(near, key=lambda x: (x[0], x[1], x[3]))[4] if near else None
        assert got[i] == want, (k, t, i)
    assert asof(left.limit(0), right, ["k"], "t", "t").count() == 0 and asof(left, right.limit(0), ["k"], "t", "t").filter("match is null").count() == 300


def test_event_windows_have_no_nested_loop(spark, sf_dir):
    df = eventstudy.event_windows(catalogue.walk(spark, sf_dir), catalogue.quarter_events(spark, sf_dir))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search("NestedLoop|Cartesian", plan)


@pytest.mark.parametrize("blocks", [None, 1, 3])
def test_gram_correlations_equal_pandas(spark, blocks):
    rng = np.random.default_rng(9)
    wide = pd.DataFrame(rng.normal(size=(600, 23)), columns=[f"a{i}" for i in range(23)])
    wide["a1"] = wide["a0"] * 2 + 1
    wide["a2"] = 0.1
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide.loc[:, "a3"] = np.nan
    wide.loc[5, "a3"] = 1.0
    long = [(k, dt.date(2020, 1, 1) + dt.timedelta(days=i), None if np.isnan(v) else float(v)) for k in wide for i, v in enumerate(wide[k])]
    df = spark.createDataFrame(long, "asset_key string, date date, ret double")
    sums = {(r["a"], r["b"]): r for r in gram.pair_sums(df, blocks=blocks).withColumn("corr", gram.pearson()).collect()}
    want, known = wide.corr(), wide.notna().astype(int)
    n = known.T @ known
    for a in wide:
        for b in wide:
            if a <= b:
                r = sums.get((a, b))
                assert (r is None) == (n.loc[a, b] == 0)
                if r is not None:
                    w = want.loc[a, b]
                    assert r["n"] == n.loc[a, b] and (r["corr"] is None or abs(r["corr"] - w) < 1e-9)
                    assert (r["corr"] is None) == (np.isnan(w) or "a2" in (a, b))
    assert correlation.correlation_matrix(df.limit(0)).count() == 0


def test_pearson_reads_the_table_once(spark, sf_dir):
    plan = gram.pair_sums(catalogue.table(spark, sf_dir, "lineitem").selectExpr("cast(l_suppkey as string) asset_key", "l_shipdate as date", "l_discount as ret"), blocks=2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "NestedLoop" not in plan
