"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments. Fingerprints that differ in at most three bits
have a segment that differs in at most one, so they share one of that segment's variants with one
bit wiped out. Every distinct fingerprint is indexed under all 64 one-wildcard variants; equal
variants are joined and the whole fingerprints verified inside the join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, whole_row
from .components import components


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned fingerprint of a text: words lower-cased in A-Z, joined to shingles by a space; a bit
    is 1 if it is set in over half of the shingles' XXH64. Fewer words: one shingle; none: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    votes, total = np.zeros(64, np.int64), n - shingle + 1
    for k in range(0, total, 1 << 15):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : min(k + (1 << 15), total)].tolist(), ends[k + shingle - 1 :].tolist(), strict=False)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, h (a hash of the text), fp (the fingerprint as a signed long) of every row."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                fps = np.array([simhash(t, shingle) for t in texts[a:b].to_pylist()], "<u8").view("<i8")
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(fps)], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("h")).mapInArrow(run, "doc_id long, h long, fp long")


def links(fps: DataFrame, radius: int = 3) -> DataFrame:
    """The pairs (a < b) of distinct fingerprints (column fp) that differ in 1 to radius bits; radius is
    at most 3, where two segments suffice. A pair is accepted at one variant only: the wiped bit is
    the differing one (the lowest, where the segment is equal), in the first segment that qualifies."""
    if not 0 < radius <= 3:
        raise ValueError("two segments find at most three differing bits")
    low = F.lit(0xFFFFFFFF)
    segment = F.when(F.col("v") < 32, F.col("fp").bitwiseAND(low)).otherwise(F.shiftrightunsigned("fp", 32))
    wild = F.col("v").bitwiseAND(F.lit(31))
    key = F.expr("shiftleft(cast(v as bigint), 32)").bitwiseOR(segment.bitwiseAND(F.bitwise_not(F.expr("shiftleft(1L, v & 31)"))))
    index = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("v")).select("fp", wild.alias("wild"), (F.col("v") < 32).alias("lower"), key.alias("key"))
    a, b = index.alias("a"), index.alias("b")
    accept = f"""
        a.key = b.key and a.fp < b.fp and bit_count(a.fp ^ b.fp) <= {int(radius)}
        and case when a.lower then (a.fp ^ b.fp) & 4294967295L else shiftrightunsigned(a.fp ^ b.fp, 32) end
            in (0L, shiftleft(1L, a.wild))
        and (a.wild = 0 or case when a.lower then (a.fp ^ b.fp) & 4294967295L else shiftrightunsigned(a.fp ^ b.fp, 32) end <> 0L)
        and (a.lower or bit_count((a.fp ^ b.fp) & 4294967295L) > 1)"""
    # sizes are estimated without the 64 rows a fingerprint, so a side that looks small could be broadcast through the driver
    return a.hint("merge").join(b.hint("merge"), F.expr(accept)).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def grouped(docs: DataFrame, radius: int = 3, shingle: int = 3) -> DataFrame:
    """doc_id, h, fp, component_id, keep_h: stored fingerprints with their groups.

    component_id is the smallest doc_id reachable over links (null only where no member has one);
    with keep_h it names the row that stands for the group: its smallest doc_id (null ids last), then
    the smallest text hash. A null text counts as empty; texts without words have fingerprint zero and link like
    any other; repeated rows share their fingerprint; other columns are ignored; an empty table
    gives no rows. Copies meet in one distinct fingerprint before any pair is looked for.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    classes = materialize(rows.groupBy("fp").agg(first), "classes")
    joined = components(links(classes.select("fp"), radius))
    named = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    roots = named.groupBy("root").agg(F.min("first").alias("first"))
    named = materialize(named.select("fp", "root").join(roots, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("keep_h")), "named")
    return rows.join(named, "fp").select("doc_id", "h", "fp", "component_id", "keep_h")


def hex16(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; see `grouped`."""
    return grouped(docs, radius).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = 3) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (see `grouped`)."""
    keep = materialize(grouped(docs, radius).select(F.col("component_id").alias("_id"), F.col("keep_h").alias("_h")).distinct(), "kept")
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    rows = rows.join(keep, rows["_doc"].eqNullSafe(keep["_id"]) & (rows["_hash"] == keep["_h"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
