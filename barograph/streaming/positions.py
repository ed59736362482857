"""Trades that follow a stream of bars, with one row of state an asset."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.backtest import CostModel

TRADES = "asset_key string, trade_id long, entry_date timestamp, exit_date timestamp, entry_price double, exit_price double, bars_held long, ret double"
STATE = "date timestamp, close double, signal double, position double, held boolean, trade_id long, entry_date timestamp, entry_price double, bars long, growth double"


class _Follower(StatefulProcessor):
    """One asset's position from bar to bar: yesterday's signal, the open trade if there is one, and the last bar."""

    def __init__(self, cost: float, idle_ms: int):
        self.cost, self.idle_ms = cost, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("position", STATE)

    def close(self) -> None:
        pass

    def _trade(self, key: tuple, s: dict) -> tuple:
        return (key[0], s["trade_id"], s["entry_date"], s["date"], s["entry_price"], s["close"], s["bars"], s["growth"] - 1)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).dropna(subset=["date", "close"]).sort_values("date").drop_duplicates("date", keep="last")
        s = dict(zip(STATE_NAMES, self.state.get(), strict=True)) if self.state.exists() else None
        out = []
        for date, close, signal in bars[["date", "close", "signal"]].itertuples(index=False):
            date = date.to_pydatetime()
            if s is not None and date <= s["date"]:
                continue  # late or repeated
            signal = 0.0 if pd.isna(signal) else float(signal)
            if s is None:
                s = dict(zip(STATE_NAMES, (date, float(close), signal, 0.0, False, 0, date, float(close), 0, 1.0), strict=True))
                continue
            move = close / s["close"] - 1 if s["close"] else 0.0
            position, was = s["signal"], s["held"]
            held = True if position == 1 else False if position == 0 else was
            net = position * move - abs(position - s["position"]) * self.cost
            s |= {"date": date, "close": float(close), "signal": signal, "position": position, "held": held}
            if held and not was:
                s |= {"trade_id": s["trade_id"] + 1, "entry_date": date, "entry_price": float(close), "bars": 0, "growth": 1 + net}
            elif held or was:
                s |= {"bars": s["bars"] + 1, "growth": s["growth"] * (1 + net)}
            if was and not held:
                out.append(self._trade(key, s))
        if s is not None:
            self.state.update(tuple(s[c] for c in STATE_NAMES))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int(pd.Timestamp(s["date"]).tz_localize("UTC").timestamp() * 1000) + self.idle_ms)
        yield pd.DataFrame(out, columns=TRADE_NAMES)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.state.exists():
            s = dict(zip(STATE_NAMES, self.state.get(), strict=True))
            if s["held"]:
                out.append(self._trade(key, s))
            self.state.clear()
        yield pd.DataFrame(out, columns=TRADE_NAMES)


STATE_NAMES = [c.split()[0] for c in STATE.split(", ")]
TRADE_NAMES = [c.split()[0] for c in TRADES.split(", ")]


def stream_trades(bars: DataFrame, costs: CostModel | None = None, late: str = "0 seconds", idle: timedelta = timedelta(days=30)) -> DataFrame:
    """The trades of a stream of bars (asset_key, date, close, signal), each when it closes: those that `run_backtest` and
    `extract_trades` find in the whole table, costs included. A bar that is not after the asset's last one is refused.
    An asset without bars for `idle`, by the watermark (`late` behind the newest bar), is ended: its open trade comes out
    as of its last bar, and its state goes. Needs a state store of RocksDB; the session's zone is that of the dates."""
    rows = bars.selectExpr("asset_key", "cast(date as timestamp) as date", "cast(close as double) as close", "cast(signal as double) as signal").withWatermark("date", late)
    follower = _Follower((costs or CostModel()).fraction, int(idle.total_seconds() * 1000))
    return rows.groupBy("asset_key").transformWithStateInPandas(follower, TRADES, "append", "eventTime")
