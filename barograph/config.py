"""Settings of the analytics, as frozen values; pass a changed copy (dataclasses.replace) to override."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from datetime import date


@dataclass(frozen=True)
class Analysis:
    trading_days: int = 252
    risk_free: float = 0.02
    start: date = date(2015, 1, 1)
    lookback_years: int = 10
    vol_short: int = 20
    vol_long: int = 60
    sma: tuple[int, ...] = (20, 50, 200)
    ema: tuple[int, ...] = (20, 50)
    rsi: int = 14
    macd: tuple[int, int, int] = (12, 26, 9)
    bollinger: tuple[int, float] = (20, 2.0)
    atr: int = 14
    trend: tuple[int, int] = (50, 200)
    regime: tuple[float, float, int] = (0.33, 0.66, 20)
    correlation: int = 60
    block: str | None = "year"  # the calendar unit that long series are cut into; None: an asset is never cut


@dataclass(frozen=True)
class Backtest:
    capital: float = 100_000.0
    cost_bps: float = 5.0
    slippage_bps: float = 2.0
    dev: tuple[date, date] = (date(2018, 1, 1), date(2023, 12, 31))
    oos: tuple[date, date] = (date(2024, 1, 1), date(2025, 12, 31))


@dataclass(frozen=True)
class StrategyDefaults:
    ma: tuple[int, int] = (50, 200)
    rsi: tuple[int, float, float] = (14, 30.0, 50.0)


@dataclass(frozen=True)
class Config:
    analysis: Analysis = field(default_factory=Analysis)
    backtest: Backtest = field(default_factory=Backtest)
    strategies: StrategyDefaults = field(default_factory=StrategyDefaults)
    snapshot_ttl_hours: float = field(default_factory=lambda: float(os.environ.get("BAROGRAPH_SNAPSHOT_TTL_HOURS", "12")))


CONFIG = Config()
KEYS = ("asset_key",)
PRICES = ("open", "high", "low", "close", "adj_close")
