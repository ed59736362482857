"""The calendar of dated macro events."""

from __future__ import annotations

import time
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import EVENTS, DataValidationError
from .store import EventLog

COLUMNS = ("date", "country", "event", "expected", "actual", "previous")
#: The kinds of event, and the published days of FOMC rate decisions.
EVENT_TYPES = ("Fed Rate Decision", "US CPI", "US Employment (NFP)", "US GDP", "RBI Rate Decision", "India CPI")
FOMC_DATES = (
    "2022-03-16", "2022-05-04", "2022-06-15", "2022-07-27", "2022-09-21", "2022-11-02", "2022-12-14",
    "2023-02-01", "2023-03-22", "2023-05-03", "2023-06-14", "2023-07-26", "2023-09-20", "2023-11-01", "2023-12-13",
    "2024-01-31", "2024-03-20", "2024-05-01", "2024-06-12", "2024-07-31", "2024-09-18", "2024-11-07", "2024-12-18",
    "2025-01-29", "2025-03-19", "2025-05-07", "2025-06-18", "2025-07-30",
)


def seed_events(spark: SparkSession) -> DataFrame:
    """The FOMC days without figures."""
    return spark.createDataFrame([(date.fromisoformat(d), "US", EVENT_TYPES[0], None, None, None) for d in FOMC_DATES], EVENTS)


def typed(raw: DataFrame) -> DataFrame:
    """raw as an event table: missing columns are NULL, rows without a valid date go. date and event are
    required columns."""
    missing = {"date", "event"} - set(raw.columns)
    if missing:
        raise DataValidationError(f"no column {', '.join(sorted(missing))}")
    kinds = {"date": "date", "country": "string", "event": "string"}
    cols = [(F.col(c) if c in raw.columns else F.lit(None)).cast("string").try_cast(kinds.get(c, "double")).alias(c) for c in COLUMNS]
    return raw.select(*cols).filter("date is not null")


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a CSV file with a header, in date order."""
    return typed(spark.read.option("header", True).csv(path)).orderBy("date")


def write_events(events: DataFrame, path: str) -> None:
    """Sorted, as CSV with a header. The path must not be one that events still reads."""
    events.select(*COLUMNS).orderBy("date").coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def add_event(events: DataFrame, row: tuple) -> DataFrame:
    """events and one more, in date order; equal events stay apart."""
    return events.select(*COLUMNS).unionByName(events.sparkSession.createDataFrame([row], EVENTS)).orderBy("date")


def import_events(existing: DataFrame, uploaded: DataFrame, replace: bool = False) -> DataFrame:
    """existing and uploaded without repeats of (date, event, country): existing rows, then earlier rows
    win; NULL countries are equal. replace drops the existing ones."""
    new = typed(uploaded).withColumn("_source", F.lit(1)).withColumn("_seq", F.monotonically_increasing_id())
    both = new if replace else existing.select(*COLUMNS).withColumn("_source", F.lit(0)).withColumn("_seq", F.monotonically_increasing_id()).unionByName(new)
    first = Window.partitionBy("date", "event", "country").orderBy("_source", "_seq")
    return both.withColumn("_n", F.row_number().over(first)).filter("_n = 1").select(*COLUMNS).orderBy("date")


def of_type(events: DataFrame, event: str | None = None) -> DataFrame:
    """Newest first; all types without event (or with "All")."""
    rows = events if event in (None, "All") else events.filter(F.col("event") == event)
    return rows.orderBy(F.col("date").desc())


def event_types(events: DataFrame) -> DataFrame:
    return events.select("event").distinct().orderBy("event")


class EventCalendar:
    """A calendar kept as an event log: additions are appended and made one when the calendar is read, so nothing passes
    through the driver, and of two writers at a time both are kept."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time, seed: DataFrame | None = None):
        self.spark, self.seed = spark, seed
        self.log = EventLog(spark, path, COLUMNS, ("date", "event", "country"), clock)

    def load(self) -> DataFrame:
        """The calendar in date order, seeded (with the FOMC days, if nothing else is given) if there is none yet."""
        rows = self.log.read()
        if rows is None:
            self.log.append(typed(seed_events(self.spark) if self.seed is None else self.seed))
            rows = self.log.read()
        return rows.orderBy("date")

    def add(self, row: tuple) -> DataFrame:
        """One more event; equal events stay apart."""
        self.load()
        self.log.append(self.spark.createDataFrame([row], EVENTS).coalesce(1))
        return self.load()

    def upload(self, uploaded: DataFrame, replace: bool = False) -> DataFrame:
        """More events, after which all are unique (see `import_events`); replace drops the existing ones."""
        self.load()
        self.log.append(typed(uploaded), "replace" if replace else "unique")
        return self.load()

    def compact(self) -> DataFrame:
        """Stores the calendar as one table, which later reads begin with."""
        self.log.compact()
        return self.load()
