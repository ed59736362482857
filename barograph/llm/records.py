"""Length-delimited binary record files of token ids, with a separate offset index.

A record is: unsigned 64-bit length of the body; masked checksum of those eight bytes; body; masked
checksum of the body; one line feed. All numbers are little-endian. The body is a flag byte (1: the
doc_id is null, 2: ids take four bytes instead of two), the doc_id (signed 64-bit), then the ids.
The checksum is CRC-32, masked (rotated right by 15 bits, plus a constant), so that a stored
checksum of bytes that hold checksums is not weak.

Spark writes the files (its text sink copies a value's bytes as they are and ends each with the line
feed) and lists and reads them (its binaryFile source), so they can live in any store it knows.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, slices, small_batches
from .tokens import default_path, encoder

MASK_DELTA = 0xA282EAD8
_HEAD, _SUM, _BODY = struct.Struct("<QI"), struct.Struct("<I"), struct.Struct("<Bq")


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    length = struct.pack("<Q", len(body))
    return b"".join((length, _SUM.pack(masked(length)), body, _SUM.pack(masked(body))))


def encode_body(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian unsigned 32-bit."""
    wide = np.frombuffer(ids, "<u4")
    narrow = not wide.size or int(wide.max()) < 65536
    flags = (doc_id is None) | (0 if narrow else 2)
    return _BODY.pack(flags, doc_id or 0) + (wide.astype("<u2").tobytes() if narrow else ids)


def decode_body(body: bytes) -> tuple[int | None, bytes]:
    flags, doc_id = _BODY.unpack_from(body)
    ids = body[_BODY.size :]
    return None if flags & 1 else doc_id, ids if flags & 2 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def frames(data: bytes):
    """(offset, body) of each record of a file; ValueError on a damaged or cut file."""
    at = 0
    while at < len(data):
        if at + _HEAD.size > len(data):
            raise ValueError(f"record at {at}: cut header")
        length, check = _HEAD.unpack_from(data, at)
        if masked(data[at : at + 8]) != check:
            raise ValueError(f"record at {at}: damaged length")
        end = at + _HEAD.size + length
        body = data[at + _HEAD.size : end]
        if end + 5 > len(data) or _SUM.unpack_from(data, end)[0] != masked(body) or data[end + 4] != 10:
            raise ValueError(f"record at {at}: damaged body")
        yield at, body
        at = end + 5


def body_at(data: bytes, offset: int, length: int) -> bytes:
    at = offset + _HEAD.size
    return data[at : at + length]


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1, file_bytes: int = 24 << 20) -> None:
    """Writes every document's ids and end id in ascending doc_id order (null ids first, equal ids by
    a hash of their text). Files hold about file_bytes of text each. A null text counts as empty;
    repeated rows are written as often as they occur; other columns are ignored."""
    small_batches(docs.sparkSession)
    vocabulary = tokenizer or default_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    rows = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // file_bytes)), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches):
        encode, end = encoder(vocabulary), np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for a, b in slices(column):
                out = [frame(encode_body(i, x + end)) for i, x in zip(ids[a:b], encode(column[a:b]), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    rows.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value")).write.option("compression", "none").text(path)


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """Reads and verifies every record file: file, ordinal, offset, length (bytes of the body), doc_id,
    n_tokens, ids_crc32 of the ids as little-endian unsigned 32-bit. One file is in memory at a time."""
    names = ["file", "ordinal", "offset", "length", "doc_id", "n_tokens", "ids_crc32"]
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                name, data, out = batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), []
                for n, (at, body) in enumerate(frames(data)):
                    doc_id, ids = decode_body(body)
                    out.append((name, n, at, len(body), doc_id, len(ids) // 4, zlib.crc32(ids)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, "file string, ordinal long, offset long, length long, doc_id long, n_tokens long, ids_crc32 long")


def write_index(spark: SparkSession, path: str, index: str) -> DataFrame:
    """The offset index of the record files at path, read back from them and stored at index: what
    scan_records gives. Returns the stored index."""
    scanned = scan_records(spark, path)
    scanned.write.parquet(index)
    return spark.read.schema(scanned.schema).parquet(index)


def read_shuffled(spark: SparkSession, path: str, index: DataFrame, seed: int = 0) -> DataFrame:
    """The records in a random order that seed fixes: doc_id, ids (binary), epoch_key. Only the offsets
    in the index are read from each file; a part of the index gives those records only."""
    wanted = index.groupBy("file").agg(F.collect_list(F.struct("offset", "length")).alias("spans"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(F.col("path").alias("file"), "content")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                data, out = batch.column(0)[k].as_py(), []
                for span in batch.column(1)[k].as_py():
                    out.append(decode_body(body_at(data, span["offset"], span["length"])))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary())], names=["doc_id", "ids"])

    rows = files.join(wanted, "file").select("content", "spans").mapInArrow(run, "doc_id long, ids binary")
    return rows.withColumn("epoch_key", F.xxhash64(F.lit(seed), "doc_id", "ids")).orderBy("epoch_key")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, file_bytes: int = 24 << 20) -> DataFrame:
    """Writes docs as record files with an index into the shared folder and returns, from what is read
    back, doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file, offset. Files
    are numbered in doc_id order, so starts add up over (file, ordinal)."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    write_records(docs, path, tokenizer, end_id, file_bytes)
    index = write_index(spark, path, f"{path}-index")
    totals = index.groupBy("file").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy(F.regexp_extract("file", r"part-(\d+)", 1).cast("long"), "file")) - F.col("n")).drop("n")
    here = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("ordinal")) - F.col("n_tokens")
    return index.withColumn("here", here).join(totals, "file").select("doc_id", (F.col("base") + F.col("here")).alias("start"), "n_tokens", "ids_crc32", "file", "offset")
