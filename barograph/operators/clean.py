"""Cleaning of raw price bars, all assets at once."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import PRICES
from ..functions.series import BLOCK, running
from ..functions.windows import clean_number, growth, ratio
from ..schema import DataValidationError

_CANONICAL = {"Date": "date", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Adj Close": "adj_close", "Volume": "volume"}
COUNTERS = ("rows_in", "rows_out", "duplicates_removed", "missing_filled", "invalid_ohlc_rows")


def normalise_columns(df: DataFrame) -> DataFrame:
    """Provider names to ours: trimmed, in title case; of names that become equal the first stays, and
    others than date, prices and volume go (asset_key and ingest_seq stay)."""
    found: dict[str, str] = {}
    for c in df.columns:
        name = _CANONICAL.get(c.strip().title()) or (c if c in ("asset_key", "ingest_seq", *_CANONICAL.values()) else None)
        if name:
            found.setdefault(name, c)
    order = ["asset_key", "ingest_seq", *_CANONICAL.values()]
    return df.select(*(F.col(f"`{found[n]}`").alias(n) for n in order if n in found))


def _staged(raw: DataFrame) -> DataFrame:
    """raw with its flags; later flags look only at rows that earlier steps keep."""
    missing = [c for c in ("asset_key", "date", "close") if c not in raw.columns]
    if missing:
        raise DataValidationError(f"no column {', '.join(missing)}")
    df = raw if "adj_close" in raw.columns else raw.withColumn("adj_close", F.col("close"))
    if "ingest_seq" not in df.columns:
        df = df.withColumn("ingest_seq", F.lit(0))
    if dict(df.dtypes)["date"] == "string":
        df = df.withColumn("date", F.col("date").try_cast("timestamp_ntz"))
    elif dict(df.dtypes)["date"] == "timestamp":  # keeps the wall time of the session's zone
        df = df.withColumn("date", F.col("date").cast("timestamp_ntz"))
    numbers = [c for c in (*PRICES, "volume") if c in df.columns]
    df = df.withColumns({c: clean_number(c) for c in numbers})
    newest = Window.partitionBy("asset_key", "date").orderBy(F.col("ingest_seq").desc())
    df = df.withColumn("_dated", F.col("date").isNotNull())
    df = df.withColumn("_repeat", F.col("_dated") & (F.row_number().over(newest) > 1))
    bad = F.lit(False)
    if all(c in df.columns for c in PRICES[:4]):
        o, h, low, c = (F.col(x) for x in PRICES[:4])
        bad = (h < low) | (h < o) | (h < c) | (low > o) | (low > c) | (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0)
    df = df.withColumn("_bad", F.col("_dated") & ~F.col("_repeat") & F.coalesce(bad, F.lit(False)))
    return df.withColumn("_kept", F.col("_dated") & ~F.col("_repeat") & ~F.col("_bad") & F.col("close").isNotNull())


def _filled(staged: DataFrame, block: str | None) -> DataFrame:
    """The kept rows of a staged table, in canonical columns."""
    df = running(staged.filter("_kept"), {c: ("last", c) for c in PRICES if c in staged.columns}, block=block)
    if "volume" in df.columns:
        df = df.withColumn("volume", F.coalesce("volume", F.lit(0.0)))
    return df.select("asset_key", "date", *(c for c in (*PRICES, "volume") if c in df.columns))


def clean_bars(raw: DataFrame, block: str | None = BLOCK) -> DataFrame:
    """One row per asset and time, in the order of the canonical columns.

    Undated rows go; of rows with one time the last by ingest_seq stays; text becomes numbers or
    NULL; rows whose four prices contradict each other or are not positive go, as do rows without
    close; missing prices repeat the last known; missing volume is 0.
    """
    return _filled(_staged(raw), block)


def _counters(staged: DataFrame) -> dict[str, Column]:
    """Aggregates over a staged table, by name."""
    count = lambda c: F.count(F.when(c, 1))
    holes = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in PRICES if c in staged.columns), F.lit(0))
    filled = F.coalesce(F.sum(F.when(F.col("_kept"), holes).otherwise(0)), F.lit(0))
    made = (F.count("*"), count(F.col("_kept")), count(F.col("_repeat")), filled, count(F.col("_bad")))
    return dict(zip(COUNTERS, made, strict=True))


def counted(raw: DataFrame) -> tuple[DataFrame, Observation]:
    """clean_bars and the counters over all assets, which the pass that first makes the bars observes. Windows are plain,
    so that it reads raw once."""
    staged, counters = _staged(raw), Observation("cleaning")
    return _filled(staged.observe(counters, *(c.alias(name) for name, c in _counters(staged).items())), None), counters


def cleaning_report(raw: DataFrame) -> DataFrame:
    """Per asset: rows_in, rows_out, duplicates_removed, missing_filled (NULL prices before filling),
    invalid_ohlc_rows."""
    df = _staged(raw)
    return df.groupBy("asset_key").agg(*(c.alias(name) for name, c in _counters(df).items()))


def rejected_assets(raw: DataFrame) -> DataFrame:
    """asset_key, error: assets of which cleaning leaves nothing."""
    return cleaning_report(raw).filter("rows_out = 0").select("asset_key", F.lit("no usable rows").alias("error"))


def price_column(df: DataFrame) -> str:
    """What analytics use; backtests use close."""
    return "adj_close" if "adj_close" in df.columns else "close"


def add_returns(df: DataFrame, price: str | None = None, fill: bool = True, block: str | None = BLOCK) -> DataFrame:
    """Adds ret and log_ret. With fill (the default), a missing price counts as unchanged."""
    p = price or price_column(df)
    df = running(df, {"_p": ("last", p), "_q": ("before", p)} if fill else {"_q": ("lag", p)}, block=block)
    now = "_p" if fill else p
    return df.withColumn("ret", growth(now, "_q")).withColumn("log_ret", F.ln(ratio(now, "_q"))).drop("_p", "_q")


def file_key(ticker: str) -> str:
    """A ticker as a file name."""
    return re.sub(r"[=/.]", "_", ticker.replace("^", "IDX_"))
