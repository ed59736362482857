"""Bars from a stream of ticks, and alerts on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(ticks: DataFrame, key: str = "event_type", time: str = "ts", value: str = "value", interval: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Bars of a stream (or of a table): open, high, low, close, volume by key and interval.

    A bar is closed when the watermark, `late` behind the newest tick, passes its end; ticks later
    than that are dropped. State is one row per open bar.
    """
    stamped = ticks.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    bars = stamped.groupBy(F.col(key).alias("asset_key"), F.window("_t", interval).alias("w")).agg(
        F.min_by(value, "_t").alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, "_t").alias("close"), F.count("*").alias("volume")
    )
    return bars.select("asset_key", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")


def write_bars(bars: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Starts the query that appends closed bars to a parquet folder, by default until the source is empty."""
    return bars.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
