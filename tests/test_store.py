"""Stores: bucketed bars, versions, the event log, counters of one pass, strategies in chunks, ranks in ranges."""

import datetime as dt
import os
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barograph.operators import backtest as bt
from barograph.operators import clean, correlation, returns
from barograph.plans import catalogue
from barograph.schema import DataUnavailableError
from barograph.sources import bars as src
from barograph.sources import events as cal
from barograph.sources.store import BarTable, EventLog, Versions

DAY = dt.date(2020, 1, 1)


def exchanges(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().executedPlan().toString())


def test_stored_bars_prune_folders_and_need_no_exchange(spark, sf_dir, tmp_path):
    bars = catalogue.walk(spark, sf_dir)
    store = BarTable(spark, "stored_for_test", f"file://{tmp_path}/bars", "year", 3)
    store.write(bars)
    part = store.read(["A", "R"], dt.date(1996, 2, 1), dt.date(1997, 5, 31))
    want = src.in_range(bars, ["A", "R"], dt.date(1996, 2, 1), dt.date(1997, 5, 31))
    assert part.drop("block_year").exceptAll(want).count() == 0 and part.count() == want.count() > 0
    made = returns.cumulative_returns(part, block="year")
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*year#", plan)
    assert re.search(r"PushedFilters: \[[^\]]*asset_key", plan)
    before_window = plan[plan.index("Window") :]  # the rows' side of the join: window, sort, scan
    assert "Exchange" not in before_window[: before_window.index("FileScan")]
    assert all("_block" not in keys.split(",")[0] for keys in exchanges(made))
    a, b = ({(r["asset_key"], r["date"]): r["cum_ret"] for r in returns.cumulative_returns(d, block=k).collect()} for d, k in ((part, "year"), (want, None)))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-9 for k in a)
    store.write(bars.limit(0))
    assert store.read().count() == 0
    spark.sql("DROP TABLE stored_for_test")


def test_failed_save_leaves_the_version_before(spark, tmp_path):
    versions = Versions(spark, f"file://{tmp_path}/v", lambda: 1.0)
    assert versions.read() is None and versions.current() is None and versions.expire() == 0
    versions.save(spark.range(3))
    broken = spark.range(4).select(F.when(F.col("id") == 3, F.raise_error(F.lit("midway"))).otherwise(F.col("id").cast("string")).alias("id"))
    with pytest.raises(Exception, match="midway"):
        versions.save(broken)
    assert versions.read().count() == 3
    assert versions.save(spark.range(0), least=1) is None and versions.read().count() == 3


def test_reader_keeps_its_version_until_it_expires(spark, tmp_path):
    now = [1.0]
    versions = Versions(spark, f"file://{tmp_path}/v", lambda: now[0])
    first = versions.save(spark.range(3))
    now[0] = 2.0
    versions.save(spark.range(5))
    assert first.count() == 3 and versions.read().count() == 5
    assert versions.expire(1) > 0 and versions.read().count() == 5


def test_clear_touches_own_files_only(spark, bars, tmp_path):
    store = src.SnapshotStore(spark, f"file://{tmp_path}/snap", 12, lambda: 0.0)
    store.get(store.path("^X", DAY, DAY), lambda: bars([1, 2]))
    store.get(store.path("Y=F", DAY, DAY), lambda: bars([1, 2, 3]))
    foreign = [f"{tmp_path}/snap/notes.txt", f"{tmp_path}/snap/IDX_X_2020-01-01_2020-01-01_1d/readme", f"{tmp_path}/snap/other/deep/file"]
    for f in foreign:
        os.makedirs(os.path.dirname(f), exist_ok=True)
        with open(f, "w") as out:
            out.write("mine")
    assert store.clear() > 0 and store.clear() == 0
    assert all(os.path.exists(f) for f in foreign)
    assert store.read(store.path("^X", DAY, DAY)) is None and not os.path.exists(f"{tmp_path}/snap/Y_F_2020-01-01_2020-01-01_1d")


def test_a_source_is_read_once(spark, bars, tmp_path):
    reads = spark.sparkContext.accumulator(0)
    store = src.SnapshotStore(spark, f"file://{tmp_path}/snap", 12, lambda: 0.0)

    def fetch():
        count = F.udf(lambda x: reads.add(1) or x, "double")
        return bars([1.0, 2.0, 3.0]).coalesce(1).withColumn("close", count("close"))

    rows, how = store.get(store.path("^X", DAY, DAY), fetch)
    assert how == "fetched" and rows.count() == 3 and reads.value == 3


def test_log_keeps_both_of_two_writers(spark, tmp_path):
    clock = iter(range(1, 1000))
    a, b = (EventLog(spark, f"file://{tmp_path}/log", ("k", "v"), ("k",), lambda: next(clock)) for _ in range(2))
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    got = lambda log: sorted(((r["k"], r["v"]) for r in log.read().collect()), key=repr)
    assert a.read() is None
    a.append(rows(("x", 1)))
    b.append(rows(("x", 2), (None, 3)))
    assert got(a) == got(b) == sorted([("x", 1), ("x", 2), (None, 3)], key=repr)
    b.append(rows(("x", 9), (None, 4), ("y", 5)), "unique")  # an upload: the first of each key stays
    want = sorted([("x", 1), (None, 3), ("y", 5)], key=repr)
    assert got(a) == want
    a.append(rows(("x", 7)))
    assert got(b) == sorted([*want, ("x", 7)], key=repr)
    b.compact()
    assert got(a) == sorted([*want, ("x", 7)], key=repr)
    b.append(rows(("z", 1)))
    b.append(rows(("x", 8)), "unique")
    assert got(a) == sorted([*want, ("z", 1)], key=repr)
    a.compact()
    assert a.expire() > 0 and got(b) == sorted([*want, ("z", 1)], key=repr)
    a.append(rows(("q", 0), ("q", 1)), "replace")
    assert got(b) == [("q", 0)]


def test_addition_during_compaction_is_kept(spark, tmp_path):
    clock = iter(range(1, 1000))
    log = EventLog(spark, f"file://{tmp_path}/log", ("k",), ("k",), lambda: next(clock))
    log.append(spark.createDataFrame([("a",)], "k string"))
    save = log.base.save

    def slow(rows, note):
        log.append(spark.createDataFrame([("b",)], "k string"))
        return save(rows, note)

    log.base.save = slow
    log.compact()
    assert sorted(r["k"] for r in log.read().collect()) == ["a", "b"]


def test_calendar_needs_no_rows_in_the_driver(spark, tmp_path, monkeypatch):
    calendar = cal.EventCalendar(spark, f"file://{tmp_path}/c")
    more = spark.createDataFrame([("2026-01-02", "US CPI")], "date string, event string")
    calendar.upload(more)
    kept = calendar.upload(more)
    assert kept.count() == 29 and kept.columns == list(cal.COLUMNS)
    assert calendar.compact().count() == 29 and calendar.upload(more, replace=True).count() == 1


def test_counters_come_with_the_bars(spark, sf_dir):
    raw = catalogue.raw_bars(spark, sf_dir).filter("asset_key = 'click'")
    bars, counters = clean.counted(raw)
    assert bars.count() == counters.get["rows_out"]
    want = clean.cleaning_report(raw).drop("asset_key").first().asDict()
    assert {k: counters.get[k] for k in want} == want
    plan = clean.counted(raw)[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == raw._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_load_many_raises_only_if_all_fail(spark, bars, tmp_path):
    path = f"file://{tmp_path}/bars"
    bars({"A": [1, 2, 3], "B": [None, None]}).write.parquet(path)
    _, errors = src.load_many(spark, path, ["A", "B", "C"], DAY, dt.date(2021, 1, 1))
    assert sorted(r["asset_key"] for r in errors.collect()) == ["B", "C"]
    with pytest.raises(DataUnavailableError):
        src.load_many(spark, path, ["B", "C"], DAY, dt.date(2021, 1, 1))


@pytest.mark.parametrize("most", [1, 7, 10_000])
def test_chunks_carry_their_state(spark, bars, most):
    rng = np.random.default_rng(2)
    df = bars({k: (rng.random(n) + 1).tolist() for k, n in (("A", 300), ("B", 1), ("C", 40))})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        got = {(r["asset_key"], r["date"]): r["signal"] for r in bt.ChunkedStrategy(catalogue.crossed, rows_a_chunk=most).signal(df.repartition(5)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = df.toPandas().sort_values(["asset_key", "date"])
    mean = rows.groupby("asset_key")["close"].transform(lambda x: x.expanding().mean())
    want = {(k, d.to_pydatetime()): float(c > m + 1e-12) for k, d, c, m in zip(rows["asset_key"], rows["date"], rows["close"], mean, strict=True)}
    assert len(got) == 341 and got == want


def test_ranks_over_ranges_equal_pandas(spark):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=200) / 50, rng.integers(-3, 4, 200) / 4.0, [0.0, -0.0, 1e300, -1e300, 5e-324, 2.0, np.nextafter(2.0, 1)]])
    df = spark.createDataFrame([("A", "B", float(v)) for v in x], "a string, b string, x double")
    got = {r["x"]: r["below"] + (r["n"] + 1) / 2 for r in correlation.ranked(df, "x").collect()}
    want = pd.Series(x).rank()
    assert all(got[v] == w for v, w in zip(x, want, strict=True))
    cells = correlation.ranked(df, "x")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"windowspecdefinition\(a#\d+, b#\d+, _block#\w+, x#", cells)


@pytest.mark.parametrize("method", ["spearman", "kendall"])
def test_rank_correlations_read_bars_twice(spark, sf_dir, method):
    bars = catalogue.table(spark, sf_dir, "lineitem").selectExpr("l_returnflag as asset_key", "cast(date_trunc('week', l_shipdate) as timestamp_ntz) as date", "l_discount as ret")
    plan = correlation.correlation_matrix(bars, method=method)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem") <= 1  # the pairs are stored: what is left is the diagonal's counts


def test_bars_of_default_dates_counts_every_bar(spark, sf_dir):
    """The default range goes from 2015 to today, so no hour of the events is left out."""
    rows = catalogue.table(spark, sf_dir, "events").filter("ts >= '2015-01-01' and ts < current_date() + 1")
    want = rows.groupBy("event_type").agg(F.countDistinct(F.date_trunc("hour", "ts")), F.max(F.date_trunc("hour", "ts")).cast("string"))
    got = catalogue.QUERIES["bars_of_default_dates"](spark, sf_dir).select("asset_key", "n", F.col("last").cast("string"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
