"""Streamed trades equal those of the whole table."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from barograph.operators import backtest as bt
from barograph.streaming import bars as streaming
from barograph.streaming.positions import stream_trades

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, STORE)
    yield
    spark.conf.set(name, before)


def test_streamed_trades_equal_batch(spark, rocks, tmp_path):
    rng, rows = np.random.default_rng(4), []
    for key in ("A", "B"):
        price, signal = 100.0, 0.0
        for i in range(90):
            price *= 1 + rng.normal() / 50
            signal = signal if rng.random() < 0.7 else float(rng.choice([0.0, 1.0, 0.5, -1.0]))
            rows.append((key, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), price, signal if rng.random() < 0.95 else None))
    df = spark.createDataFrame(rows, "asset_key string, date timestamp, close double, signal double")
    start = dt.datetime(2020, 1, 1)
    for k in range(3):  # a file a batch; the last two repeat bars of the one before
        df.filter(F.col("date").between(start + dt.timedelta(days=max(0, 30 * k - 5)), start + dt.timedelta(days=30 * k + 29))).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    end = spark.createDataFrame([("Z", start + dt.timedelta(days=400), 1.0, 0.0)], df.schema)  # moves the watermark on
    end.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    streaming.write_bars(stream_trades(stream), f"file://{tmp_path}/out", f"file://{tmp_path}/cp").awaitTermination()
    got = {(r["asset_key"], r["trade_id"]): r for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    batch = bt.extract_trades(bt.run_backtest(df, None)).collect()
    assert len(got) == len(batch) > 5
    for w in batch:
        g = got[(w["asset_key"], w["trade_id"])]
        assert (g["entry_date"], g["exit_date"], g["bars_held"]) == (w["entry_date"], w["exit_date"], w["bars_held"])
        assert all(abs(g[c] - w[c]) < 1e-9 for c in ("entry_price", "exit_price", "ret"))
