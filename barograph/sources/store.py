"""Stores of bars, snapshots and events: written by Spark, never rewritten in place.

A bar table is bucketed by asset and time block, so that windows inside blocks need no exchange, and partitioned by year,
so that ranges of dates prune folders. Versions and logs keep what readers hold: new files are added, one small row makes
them current, and only files that the store itself has listed are ever deleted.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.series import BLOCK, block_of, stored_block


class BarTable:
    """Bars as a table of the catalog. `path` puts its files into a folder of the caller's."""

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, unit: str = BLOCK or "year", buckets: int = 64):
        self.spark, self.name, self.path, self.unit, self.buckets = spark, name, path, unit, buckets

    def write(self, bars: DataFrame) -> None:
        """Replaces the table. Rows go to their bucket once and are sorted there, so a bucket has a file a year."""
        block = stored_block(self.unit)
        rows = bars.withColumns({block: block_of("date", self.unit), "year": F.year("date")}).repartition(self.buckets, "asset_key", block)
        out = rows.write.mode("overwrite").partitionBy("year").bucketBy(self.buckets, "asset_key", block).sortBy("asset_key", "date").format("parquet")
        (out.option("path", self.path) if self.path else out).saveAsTable(self.name)

    def read(self, keys: Sequence[str] | None = None, start: date | None = None, end: date | None = None) -> DataFrame:
        """The bars of some assets and a range of dates, both ends included, with their block; the range reaches the scan
        as years of folders and as dates, the keys as a filter on sorted files."""
        df = self.spark.table(self.name)
        if keys is not None:
            df = df.filter(F.col("asset_key").isin(list(keys)))
        if start is not None:
            df = df.filter((F.col("year") >= start.year) & (F.col("date") >= F.lit(start)))
        if end is not None:
            df = df.filter((F.col("year") <= end.year) & (F.col("date") < F.date_add(F.lit(end), 1)))
        return df.drop("year")


def parquet_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    if not Files(spark).exists(path):
        return None
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:  # a folder without a file, or gone meanwhile
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


class Files:
    """Deletes and lists in any store that Spark writes to."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def folders(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return [s.getPath().toString() for s in fs.listStatus(at) if s.isDirectory()] if fs.exists(at) else []

    def delete(self, path: str) -> int:
        """Deletes a folder; how many files went."""
        fs, at = self._at(path)
        if not fs.exists(at):
            return 0
        n = fs.getContentSummary(at).getFileCount()
        fs.delete(at, True)
        return n

    def delete_empty(self, path: str) -> None:
        fs, at = self._at(path)
        if fs.exists(at) and not fs.listStatus(at):
            fs.delete(at, False)


class Versions:
    """Versions of a table in a folder. A save writes a folder of its own, and then one row that makes it current: a save
    that fails midway changes nothing, and a reader keeps the version that it has opened."""

    POINTERS = "version string, at double, note array<string>"

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.clock, self.files = spark, path.rstrip("/"), clock, Files(spark)

    def pointers(self) -> DataFrame | None:
        return parquet_if_there(self.spark, f"{self.path}/pointers")

    def current(self) -> tuple[str, float, list[str]] | None:
        """The newest version's folder, time and note."""
        rows = self.pointers()
        newest = None if rows is None else rows.orderBy(F.col("at").desc(), F.col("version").desc()).first()
        return None if newest is None else (f"{self.path}/{newest['version']}", newest["at"], list(newest["note"]))

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self.spark.read.parquet(now[0])

    def save(self, df: DataFrame, note: Sequence[str] = (), least: int = 0) -> DataFrame | None:
        """df as the current version, read back; None, and nothing changed, if it has fewer rows than `least`."""
        version = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{version}")
        kept = self.spark.read.schema(df.schema).parquet(f"{self.path}/{version}")
        if least and kept.limit(least).count() < least:
            self.files.delete(f"{self.path}/{version}")
            return None
        row = self.spark.createDataFrame([(version, float(self.clock()), list(note))], self.POINTERS)
        row.coalesce(1).write.mode("append").parquet(f"{self.path}/pointers")
        return kept

    def expire(self, keep: int = 1) -> int:
        """Deletes all versions but the newest `keep` that have a pointer; how many files went."""
        rows = self.pointers()
        old = [] if rows is None else [r["version"] for r in rows.orderBy(F.col("at").desc(), F.col("version").desc()).select("version").collect()][keep:]  # a row a save
        return sum(self.files.delete(f"{self.path}/{v}") for v in old)

    def clear(self) -> int:
        """Deletes the versions that have a pointer, and the pointers; the folder too if nothing else is in it."""
        gone = self.expire(0) + self.files.delete(f"{self.path}/pointers")
        self.files.delete_empty(self.path)
        return gone


class EventLog:
    """A table of dated events that grows by appending. Each addition has a sequence number and says what it is: rows that
    are added as they are, an upload that makes rows unique, or one that replaces all before. What the log comes to is
    worked out when it is read; two writers at a time both keep their rows. `compact` stores the outcome and lists the
    files that are in it, so an addition that comes meanwhile is not lost."""

    def __init__(self, spark: SparkSession, path: str, columns: Sequence[str], unique: Sequence[str], clock: Callable[[], float] = time.time):
        self.spark, self.path, self.columns, self.unique, self.clock = spark, path.rstrip("/"), list(columns), list(unique), clock
        self.base = Versions(spark, f"{self.path}/base", clock)

    def append(self, rows: DataFrame, how: str = "add") -> None:
        """how: add, unique or replace."""
        if how not in ("add", "unique", "replace"):
            raise ValueError(f"unknown addition {how}")
        own = rows.select(*self.columns).withColumns({"_how": F.lit(how), "_seq": F.lit(int(self.clock() * 1e6)), "_row": F.monotonically_increasing_id()})
        own.write.mode("append").parquet(f"{self.path}/log")

    def _additions(self, merged: Sequence[str]) -> DataFrame | None:
        """The additions that are not in the base, with their file."""
        log = parquet_if_there(self.spark, f"{self.path}/log")
        if log is None:
            return None
        log = log.withColumn("_file", F.col("_metadata.file_path"))
        return log.filter(~F.col("_file").isin(list(merged))) if merged else log

    def read(self) -> DataFrame | None:
        """The events; None before the first addition. Of rows up to the last upload that are equal in the unique columns
        the first stays, NULLs being equal; rows before the last replacement go."""
        now = self.base.current()
        rows = self._outcome(now, self._additions(now[2] if now else ()))
        return None if rows is None else rows.select(*self.columns)

    def _outcome(self, now: tuple | None, new: DataFrame | None) -> DataFrame | None:
        base = None if now is None else self.spark.read.parquet(now[0]).withColumn("_how", F.lit("add"))
        if base is None and new is None:
            return None
        rows = new.drop("_file") if base is None else base if new is None else base.unionByName(new.drop("_file"))
        of = lambda *how: F.max(F.when(F.col("_how").isin(*how), F.col("_seq")))
        marks = rows.agg(of("replace").alias("reset"), of("unique", "replace").alias("upto"))
        reset, upto = F.coalesce(marks.select("reset").scalar(), F.lit(-1)), F.coalesce(marks.select("upto").scalar(), F.lit(-1))
        live = rows.filter(F.col("_seq") >= reset)
        first = Window.partitionBy(*self.unique, F.col("_seq") <= upto).orderBy("_seq", "_row")
        return live.withColumn("_n", F.row_number().over(first)).filter((F.col("_seq") > upto) | (F.col("_n") == 1)).drop("_n")

    def compact(self) -> None:
        """Stores the outcome of the additions so far as the base of later reads. Their files stay, for readers that have
        them open, until `expire`."""
        now = self.base.current()
        new = self._additions(now[2] if now else ())
        files = [] if new is None else [r[0] for r in new.select("_file").distinct().collect()]  # a name an addition
        if files:
            live = self._outcome(now, new.filter(F.col("_file").isin(files)))
            self.base.save(live.drop("_how"), sorted({*files, *(now[2] if now else ())}))

    def expire(self) -> int:
        """Deletes older bases and the additions that are in the base; how many files went."""
        now = self.base.current()
        return 0 if now is None else self.base.expire(1) + sum(self.base.files.delete(f) for f in now[2])
