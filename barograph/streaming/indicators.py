"""Indicators that follow a stream of closed bars, with a small state per asset."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "asset_key string, date timestamp, price double, ema double"
STATE = "ema double, seen long, last timestamp"


def stream_ema(bars: DataFrame, span: int, price: str = "close", min_periods: int | None = None) -> DataFrame:
    """asset_key, date, price, ema of every new bar: the same recursion as the batch indicator, carried on
    from the last bar seen. Bars must come in date order from batch to batch; within a batch they are
    sorted, and bars not after the last one seen are dropped (a replay changes nothing). State is one
    row an asset: the mean, how many prices it holds, and the last date."""
    alpha, least = 2.0 / (span + 1), span if min_periods is None else min_periods

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mean, seen, last = state.get if state.exists else (None, 0, None)
        rows = pd.concat(list(batches)).dropna(subset=["price"]).sort_values("date").drop_duplicates("date", keep="last")
        if last is not None:
            rows = rows[rows["date"] > pd.Timestamp(last)]
        if rows.empty:
            return
        start = pd.concat([pd.Series([] if mean is None else [mean], dtype=float), rows["price"].astype(float)])
        means = start.ewm(alpha=alpha, adjust=False).mean().to_numpy()[0 if mean is None else 1 :]
        counts = pd.Series(range(seen + 1, seen + 1 + len(rows)), index=rows.index)
        state.update((float(means[-1]), int(counts.iloc[-1]), rows["date"].iloc[-1].to_pydatetime()))
        yield pd.DataFrame({"asset_key": key[0], "date": rows["date"], "price": rows["price"], "ema": pd.Series(means, index=rows.index).where(counts >= least)})

    rows = bars.selectExpr("asset_key", "cast(date as timestamp) as date", f"cast({price} as double) as price")
    return rows.groupBy("asset_key").applyInPandasWithState(follow, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
