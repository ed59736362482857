"""Event studies: what prices did around dated events.

Events and bars meet by asset and row number: each event is placed on its bar by an as-of join, its
offsets are exploded, and an equi join fetches the bars. No step compares every event with every bar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.series import BLOCK, block_of, running
from ..functions.windows import growth
from .asof import asof
from .clean import price_column


def numbered(bars: DataFrame, price: str | None = None, block: str | None = BLOCK) -> DataFrame:
    """asset_key, date, rn (from 1 in date order), price: bars with a known price."""
    p = price or price_column(bars)
    rows = bars.filter(F.col(p).isNotNull()).select("asset_key", "date", F.col(p).alias("price"))
    return running(rows, {"rn": ("count", F.lit(1))}, block=block)


def dealt(events: DataFrame, bars: DataFrame, unit: str = "year") -> DataFrame:
    """asset_key, event_date: each distinct event date for every asset whose bars had begun by the end of its calendar
    unit. Dates and assets meet by the unit, which an asset has from its first bar on."""
    dates = events.select(F.col("date").cast("timestamp_ntz").alias("event_date")).distinct().filter("event_date is not null").withColumn("_unit", block_of("event_date", unit))
    newest = dates.agg(F.max("_unit")).scalar()
    begun = bars.groupBy("asset_key").agg(block_of(F.min(F.col("date").cast("timestamp_ntz")), unit).alias("_a")).filter(F.col("_a") <= newest)
    step = F.expr(f"interval {3 if unit == 'quarter' else 1} {'month' if unit == 'quarter' else unit}")
    spans = begun.select("asset_key", F.explode(F.sequence("_a", newest, step)).alias("_unit"))
    return dates.join(spans, "_unit").select("asset_key", "event_date")


def asof_backward(events: DataFrame, bars: DataFrame, block: str | None = BLOCK) -> DataFrame:
    """event_date, asset_key, t0: the number of each asset's last bar on or before the event, however
    old; no row before the first bar."""
    met = asof(dealt(events, bars), bars.select("asset_key", F.col("date").cast("timestamp_ntz").alias("date"), "rn"), left_time="event_date", block=block)
    return met.select("asset_key", "event_date", F.col("match.rn").alias("t0")).filter("t0 is not null")


def event_windows(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 5, price: str | None = None) -> DataFrame:
    """asset_key, event_date, offset, date, price, cum_ret (since the event's bar), ret (since the bar
    before; NULL in the window's first row). Windows are cut where the bars end."""
    rows = numbered(bars, price)
    placed = asof_backward(events, rows)
    wanted = placed.select("asset_key", "event_date", F.explode(F.sequence(F.lit(-pre), F.lit(post))).alias("offset"), "t0").withColumn("rn", F.col("t0") + F.col("offset"))
    met = wanted.join(rows, ["asset_key", "rn"])
    whole = Window.partitionBy("asset_key", "event_date")
    base = F.max(F.when(F.col("offset") == 0, F.col("price"))).over(whole)
    met = met.withColumns({"cum_ret": growth("price", base), "ret": growth("price", F.lag("price").over(whole.orderBy("offset")))})
    return met.select("asset_key", "event_date", "offset", "date", "price", "cum_ret", "ret")


def study_events(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 5, price: str | None = None) -> DataFrame:
    """Per asset and event: ret_t0; ret_pre and ret_post, compounded over the offsets before and after 0;
    vol_pre and vol_post, their sample deviations; price_move over the whole window."""
    rows = event_windows(bars, events, pre, post, price)
    before, after = F.when(F.col("offset") < 0, F.col("ret")), F.when(F.col("offset") > 0, F.col("ret"))
    compound = lambda c: F.coalesce(F.product(1 + c), F.lit(1.0)) - 1
    return rows.groupBy("asset_key", "event_date").agg(
        F.max(F.when(F.col("offset") == 0, F.col("ret"))).alias("ret_t0"),
        compound(before).alias("ret_pre"),
        compound(after).alias("ret_post"),
        F.stddev_samp(before).alias("vol_pre"),
        F.stddev_samp(after).alias("vol_post"),
        growth(F.max_by("price", "offset"), F.min_by("price", "offset")).alias("price_move"),
    )


def average_event_path(bars: DataFrame, events: DataFrame, pre: int = 5, post: int = 5, price: str | None = None) -> DataFrame:
    """Per asset and offset: mean_cum_ret and n_events."""
    rows = event_windows(bars, events, pre, post, price)
    return rows.groupBy("asset_key", "offset").agg(F.avg("cum_ret").alias("mean_cum_ret"), F.count("cum_ret").alias("n_events"))
