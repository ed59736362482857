"""Exact deduplication by progressive refinement, in DataFrame functions only.

Texts are equal when they are identical after every run of ASCII white space became one space. Documents are
grouped by the length of that text, then by a hash of its beginning too, and only where a group still has
several rows by a hash of the whole. The first two steps work on a stored table of two numbers a row; the last one
reads the texts again and hashes those whose length and beginning occur more than once. Which these are is told by
a bitmap of fixed size: a foreign key that shares a bit costs a hash more and changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, remove, stored, whole_row

SPACES = r"[\x20\x09-\x0D]+"
#: Code points of a beginning, and bits of the bitmap (2 MB, in rows of 4 KB).
PREFIX, BITS = 64, 1 << 24
_ROW_BITS = 32768


def normalised(text: str | Column = "text") -> Column:
    """The text with one space for each run of ASCII white space; null is empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def shallow(norm: Column, prefix: int = PREFIX) -> list[Column]:
    """length (bytes) and start, the hash of the first code points."""
    return [F.octet_length(norm).cast("long").alias("length"), F.xxhash64(F.substring(norm, 1, prefix)).alias("start")]


def _slot(bits: int) -> tuple[Column, Column]:
    """Row and place in the bitmap of a length and start."""
    slot = F.pmod(F.xxhash64("length", "start"), F.lit(bits))
    return F.floor(slot / _ROW_BITS).cast("long"), (slot % _ROW_BITS).cast("int")


def shared_starts(docs: DataFrame, prefix: int = PREFIX) -> tuple[DataFrame, str]:
    """(length, start) of more than one row, and the path of the table of all rows' lengths and starts. Starts are
    counted only in lengths of more than one row."""
    rows, path = stored(docs.select(*shallow(normalised(), prefix)), "lengths")
    lengths = rows.groupBy("length").agg(F.count("*").alias("n")).filter("n > 1").select("length")
    counts = rows.groupBy("length", "start").agg(F.count("*").alias("n")).filter("n > 1")
    return counts.join(lengths, "length", "left_semi").select("length", "start"), path


def keyed(docs: DataFrame, *carried: Column, digests: bool = False, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """A stored row per document: row (a number of its own), doc_id, length, start, full (the SHA-256 of the whole
    text in hex, NULL where length and start occur once) and the carried columns. digests: also digest, that hash of
    every text, for callers who report it; grouping does not use it."""
    starts, path = shared_starts(docs, prefix)
    row, place = _slot(bits)
    marks = starts.select(row.alias("_row"), place.alias("_place")).groupBy("_row").agg(F.bitmap_construct_agg("_place").alias("_map"))
    marks, marks_path = stored(marks, "marks")
    own = docs.select(F.col("doc_id"), normalised().alias("_norm"), *carried).select("*", *shallow(F.col("_norm"), prefix))
    met = own.select("*", row.alias("_row"), place.alias("_place")).join(F.broadcast(marks), "_row", "left")  # at most `bits`
    byte = F.conv(F.hex(F.substring("_map", F.floor(F.col("_place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(F.expr("shiftright(_byte, _place % 8) & 1") == 1, F.lit(False))
    met = met.withColumn("_byte", byte)
    whole = F.sha2(F.col("_norm").cast("binary"), 256)
    out = [F.when(marked, whole).alias("full")] + [whole.alias("digest")] * digests
    names = [c for c in own.columns if c not in ("doc_id", "_norm", "length", "start")]
    made = materialize(met.select(F.monotonically_increasing_id().alias("row"), "doc_id", "length", "start", *out, *names), "keyed")
    for p in (path, marks_path):
        remove(docs.sparkSession, p)
    return made


def grouped(rows: DataFrame) -> DataFrame:
    """`keyed` rows with keep_id, group_size and kept. Rows equal in doc_id too are one group's like others: the
    smallest doc_id stays (null ids last), one row of it."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    groups = rows.filter("full is not null").groupBy("full", "length").agg(first.alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
    groups = groups.select(F.col("full").alias("_full"), F.col("length").alias("_length"), F.col("_first.doc_id").alias("_keep"), F.col("_first.row").alias("_keep_row"), "_n")
    groups = materialize(groups, "groups")  # a join of stored tables, whose hot keys Spark can split
    own = F.coalesce("full", F.col("row").cast("string"))  # rows without a full hash meet nothing, and do not all meet in one task
    met = rows.join(groups, (own == F.col("_full")) & (F.col("length") == F.col("_length")), "left")
    alone = F.col("_n").isNull()
    kept = alone | (F.col("row") == F.col("_keep_row"))
    return met.select(*rows.columns, F.when(alone, F.col("doc_id")).otherwise(F.col("_keep")).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"), kept.alias("kept"))


def report(docs: DataFrame, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: a row per document.

    Null and empty texts are one group, texts of white space alone another; null doc_ids come after all others, and
    a group of them alone keeps one with keep_id NULL; repeated rows are copies of each other. Texts of any length are
    hashed whole by the task that reads them. Other columns are ignored; an empty table gives no rows."""
    return grouped(keyed(docs, digests=True, prefix=prefix, bits=bits)).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """The rows of docs that `report` keeps, with all their columns (of any names) as they are. Texts are stored once
    and travel with their row's number only where some row of the same text goes."""
    rows = keyed(docs, whole_row(docs).alias("doc"), prefix=prefix, bits=bits)
    gone = grouped(rows.drop("doc")).filter("not kept").select("row")
    return rows.join(gone, "row", "left_anti").select("doc.*")
