"""Readers and writers of bar tables, and bars derived from other tables."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CONFIG
from ..functions.kept import kept
from ..functions.series import BLOCK, running
from ..operators.clean import COUNTERS, add_returns, clean_bars, counted, file_key, normalise_columns
from ..schema import DEFAULT_ASSETS, DataUnavailableError, DataValidationError
from .store import Files, Versions


def read_bars(spark: SparkSession, path: str, format: str = "parquet", keys: Sequence[str] | None = None, start: date | None = None, end: date | None = None, **options) -> DataFrame:
    """Raw bars of a long table; the range includes both ends and, like the keys, reaches the scan."""
    df = spark.read.format(format).options(**({"header": True} if format == "csv" else {}) | options).load(path)
    return in_range(normalise_columns(df), keys, start, end)


def in_range(df: DataFrame, keys: Sequence[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
    if keys is not None:
        df = df.filter(F.col("asset_key").isin(list(keys)))
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    if end is not None:
        df = df.filter(F.col("date") < F.date_add(F.lit(end), 1))
    return df


def load(raw: DataFrame) -> DataFrame:
    """Clean bars with returns."""
    return add_returns(clean_bars(raw))


def default_dates(start: date | None = None, end: date | None = None) -> tuple[date, date]:
    """The range asked for; from the configured first day to today, where an end of it is left open."""
    return start or CONFIG.analysis.start, end or date.today()


def usable(raw: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(bars with returns, errors by asset_key) of the assets asked for: those without usable rows are errors."""
    bars = load(raw.filter(F.col("asset_key").isin(list(keys))))
    found = bars.select("asset_key").distinct()
    asked = raw.sparkSession.createDataFrame([(k,) for k in keys], "asset_key string")
    return bars, asked.join(found, "asset_key", "left_anti").withColumn("error", F.lit("no usable rows"))


def load_many(spark: SparkSession, path: str, keys: Sequence[str], start: date | None = None, end: date | None = None, **how) -> tuple[DataFrame, DataFrame]:
    """(bars with returns, errors by asset_key): assets that have no usable rows are reported, not raised.
    DataUnavailableError if that is all of them."""
    start, end = default_dates(start, end)
    bars, errors = usable(read_bars(spark, path, keys=keys, start=start, end=end, **how), keys)
    if errors.count() == len(set(keys)):
        raise DataUnavailableError(f"no bars for {', '.join(keys)}")
    return bars, errors


class SnapshotStore:
    """Raw bars kept as versions of parquet folders, one set per request.

    `get` returns a fresh snapshot, else fetches and keeps one, else falls back to an old one; the flag
    tells which ("fresh", "fetched" or "stale"). An empty fetch counts as a failed one. A source is read once. The
    version before the newest stays, for readers that have it open.
    """

    def __init__(self, spark: SparkSession, root: str, ttl_hours: float | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.root, self.clock = spark, root.rstrip("/"), clock
        self.ttl = CONFIG.snapshot_ttl_hours if ttl_hours is None else ttl_hours

    def path(self, ticker: str, start: date, end: date, interval: str = "1d") -> str:
        return f"{self.root}/{file_key(ticker)}_{start}_{end}_{interval}"

    def versions(self, path: str) -> Versions:
        return Versions(self.spark, path, self.clock)

    def read(self, path: str) -> DataFrame | None:
        return self.versions(path).read()

    def age_hours(self, path: str) -> float | None:
        now = self.versions(path).current()
        return None if now is None else (self.clock() - now[1]) / 3600

    def is_fresh(self, path: str) -> bool:
        age = self.age_hours(path)
        return age is not None and age <= self.ttl

    def save(self, path: str, raw: DataFrame) -> DataFrame | None:
        """The new version, read back; None, and nothing changed, for an empty table."""
        made = self.versions(path).save(raw, least=1)
        self.versions(path).expire(2)
        return made

    def get(self, path: str, fetch: Callable[[], DataFrame], force: bool = False) -> tuple[DataFrame, str]:
        if not force and self.is_fresh(path):
            return self.read(path), "fresh"
        try:
            raw = fetch()
            try:
                made = self.save(path, raw)
            except Exception:  # a snapshot that cannot be kept must not break the load
                made = None if raw.isEmpty() else raw
            if made is None:
                raise DataUnavailableError("the source returned no rows")
            return made, "fetched"
        except Exception:
            old = self.read(path)
            if old is None:
                raise
            return old, "stale"

    def clear(self) -> int:
        """Removes all snapshots, and nothing that is not one; how many files went."""
        found = Files(self.spark).folders(self.root)
        return sum(self.versions(f).clear() for f in found if self.versions(f).pointers() is not None)


@dataclass(frozen=True)
class Loaded:
    """One asset's clean bars with returns, the cleaning report, and where they came from."""

    key: str
    asset: dict
    bars: DataFrame
    report: DataFrame
    from_cache: bool
    stale: bool


def load_asset(
    store: SnapshotStore,
    key: str,
    fetch: Callable[[str, date, date, str], DataFrame],
    start: date | None = None,
    end: date | None = None,
    interval: str = "1d",
    use_cache: bool = True,
    force: bool = False,
    assets: Sequence[tuple] = DEFAULT_ASSETS,
) -> Loaded:
    """Bars of one asset of the dimension: a fresh snapshot, else what fetch(ticker, start, end, interval) returns
    (then kept), else an old snapshot. KeyError for an unknown key; DataUnavailableError without usable rows."""
    names = ("key", "name", "ticker", "asset_class", "currency", "region", "code")
    by = {r[0]: dict(zip(names, r, strict=True)) for r in assets}
    if key not in by:
        raise KeyError(f"unknown asset {key!r}")
    asset, (start, end) = by[key], default_dates(start, end)
    path = store.path(asset["ticker"], start, end, interval)
    try:
        raw, how = store.get(path, lambda: fetch(asset["ticker"], start, end, interval), force or not use_cache)
    except Exception as e:
        raise DataUnavailableError(f"no bars of {asset['name']} ({asset['ticker']}) and no snapshot: {e}") from e
    try:
        raw = normalise_columns(raw)
        raw = raw if "asset_key" in raw.columns else raw.withColumn("asset_key", F.lit(key))
        bars, counters = counted(raw)
        bars = kept(add_returns(bars, block=None), "bars")  # one pass makes the bars and counts
        if bars.isEmpty():
            raise DataValidationError(f"no usable rows of {key}")
        report = store.spark.createDataFrame([(key, *(counters.get[c] for c in COUNTERS))], f"asset_key string, {', '.join(f'{c} long' for c in COUNTERS)}")
    except DataValidationError as e:
        raise DataUnavailableError(str(e)) from e
    return Loaded(key, asset, bars, report, how != "fetched", how == "stale")


def walk_bars(lineitem: DataFrame, block: str | None = BLOCK) -> DataFrame:
    """Daily bars by return flag: an exponential walk whose steps are the day's mean discount against 5 %."""
    days = lineitem.groupBy(F.col("l_returnflag").alias("asset_key"), F.col("l_shipdate").alias("date")).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("long")) / F.count("*") / 100.0 - 0.05).alias("shock"), F.count("*").cast("double").alias("volume")
    )
    days = running(days, {"_sum": ("sum", "shock")}, block=block)
    close = 100 * F.exp("_sum")
    return days.select("asset_key", "date", close.alias("close"), close.alias("adj_close"), "volume")


def interval_bars(ticks: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", unit: str = "hour") -> DataFrame:
    """Bars of single values: the first, highest, lowest and last of each interval, and their number."""
    bar = ticks.groupBy(F.col(key).alias("asset_key"), F.date_trunc(unit, F.col(time)).cast("timestamp_ntz").alias("date")).agg(
        F.min_by(value, time).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, time).alias("close"), F.count("*").cast("double").alias("volume")
    )
    return bar.select("asset_key", "date", "open", "high", "low", "close", F.col("close").alias("adj_close"), "volume")
