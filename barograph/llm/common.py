"""Helpers that the training-data operators share."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch that Spark hands to Python, at most (unless one row is longer).
ARROW_BYTES = 4 << 20
_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, and all tasks run in this process (tests), one
    temporary folder of this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append("file://" + tempfile.mkdtemp(prefix="spark-"))
    return _own_dir[0]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as a table in the shared folder and read again, and the table's path, for `remove`."""
    spark = df.sparkSession
    small_batches(spark)
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage and outlives executors."""
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a `stored` table whose successor is stored."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, *order: str, name: str = "numbered", partitions: int | None = None) -> DataFrame:
    """df stored in the order of these columns with _part and _at, the row's place in its part; parts are consecutive
    ranges. No window spans the table: `part_starts` gives what stands before each part."""
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    place = F.monotonically_increasing_id()
    ranged = ranged.sortWithinPartitions(*order).withColumns({"_part": F.shiftright(place, 33).cast("int"), "_at": place.bitwiseAND(F.lit((1 << 33) - 1))})
    return materialize(ranged, name)


def part_starts(stored: DataFrame) -> DataFrame:
    """_part, _before (rows of all parts before it) of a `numbered` table: a row a part."""
    counts = stored.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.orderBy("_part")) - F.col("_rows")
    return counts.select("_part", before.alias("_before"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reachable(spark)
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes: 10,000 long texts in one batch would fill an executor's
    memory outside its heap. A lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(name, str(2**31 - 1)).rstrip("bB")) > ARROW_BYTES:
        spark.conf.set(name, str(ARROW_BYTES))


def whole_row(df: DataFrame):
    """A struct of all columns, whatever their names."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def ascii_lower(col):
    """Lower case for A-Z only."""
    return F.translate(col, _UPPER, _LOWER)


def held_out(doc_id, part: int, parts: int = 5):
    """crc32(doc_id as text) mod parts == part; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def slices(texts, most: int = 2_000_000):
    """Consecutive (start, stop) ranges of an Arrow column of texts with about `most` bytes each, to bound
    memory; a longer text is a range of its own."""
    import pyarrow.compute as pc

    start = size = 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).tolist()):
        if size and size + n > most:
            yield start, i
            start, size = i, 0
        size += n + 16
    if start < len(texts):
        yield start, len(texts)


def reachable(spark: SparkSession) -> None:
    """Lets the Python workers import this package wherever the driver runs from."""
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
