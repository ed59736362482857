"""Schemas of the long tables and the asset dimension."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BARS = "asset_key string, date timestamp_ntz, open double, high double, low double, close double, adj_close double, volume double"
ASSETS = "asset_key string, name string, ticker string, asset_class string, currency string, region string, code string, display_order int"
EVENTS = "date date, country string, event string, expected double, actual double, previous double"
TRADES = "asset_key string, trade_id long, entry_date timestamp_ntz, exit_date timestamp_ntz, entry_price double, exit_price double, bars_held long, ret double"


class DataValidationError(ValueError):
    """The input cannot be made into bars."""


class DataUnavailableError(RuntimeError):
    """No source had the requested bars."""


#: The default assets in display order.
DEFAULT_ASSETS = (
    ("SP500", "S&P 500", "^GSPC", "Equity Index", "USD", "US", "SPX"),
    ("NASDAQ100", "Nasdaq-100", "^NDX", "Equity Index", "USD", "US", "NDX"),
    ("NIFTY50", "NIFTY 50", "^NSEI", "Equity Index", "INR", "India", "NIFTY"),
    ("GOLD", "Gold", "GC=F", "Commodity", "USD", "Global", "XAU"),
    ("CRUDE", "Crude Oil (WTI)", "CL=F", "Commodity", "USD", "Global", "WTI"),
    ("USDINR", "USD/INR", "USDINR=X", "FX", "INR", "India", "USDINR"),
)


def assets(spark: SparkSession, rows: Sequence[tuple] = DEFAULT_ASSETS) -> DataFrame:
    """The asset dimension; its order is the display order."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], ASSETS)


def assets_by_class(dimension: DataFrame, asset_class: str) -> DataFrame:
    return dimension.filter(F.col("asset_class") == asset_class).orderBy("display_order")


def asset_keys(dimension: DataFrame) -> DataFrame:
    return dimension.orderBy("display_order").select("asset_key")


def with_label(df: DataFrame, dimension: DataFrame) -> DataFrame:
    """Adds name (the asset's, or its key where the dimension does not have it), asset_class and display_order. The
    dimension has a row per asset and is left to the optimizer's own size check for broadcasting."""
    return df.join(dimension.select("asset_key", "name", "asset_class", "display_order"), "asset_key", "left").withColumn("name", F.coalesce("name", "asset_key"))
