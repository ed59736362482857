"""Substring deduplication by content-defined chunking.

A gear rolling hash over the last 16 bytes decides at every word start whether a chunk begins there,
so boundaries follow the content and an insertion moves only the chunks around it. Hash and digests see
the words joined by one space, so white space makes no difference. Chunks are compared by digest over the whole corpus: the first occurrence, in doc_id order, stays. Short chunks
repeat by chance, so a digest covers a chunk with the two before it, and only runs of repeated chunks
with at least `least` words in all are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import materialize, slices, whole_row

LEAST, BITS, WINDOW, MOST_WORDS = 25, 2, 3, 12
#: Bytes of the spans of all documents up to which they are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def gear_table(seed: int = 20) -> np.ndarray:
    table = np.random.default_rng(seed).integers(0, 1 << 16, 256, dtype=np.uint16)
    table[0] = 0  # the filling between texts leaves no trace
    return table


def laid_out(coded: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after another between fillings of 16 zero bytes: the buffer, as an array too, where each
    text begins, its size, and where words start. Zero bytes inside a text are part of its words."""
    fill = bytes(16)
    data = fill + fill.join(coded) + fill
    raw, sizes = np.frombuffer(data, np.uint8), np.fromiter(map(len, coded), np.int64, len(coded))
    begins = 16 + np.cumsum(sizes + 16) - (sizes + 16)
    space = _SPACE[raw] | (raw == 0)
    if 0 in sizes or data.count(0) > 16 * (len(coded) + 1):
        inside = np.zeros(len(raw) + 1, np.int32)
        np.add.at(inside, begins, 1)
        np.add.at(inside, begins + sizes, -1)
        space = _SPACE[raw] | ~np.cumsum(inside[:-1]).astype(bool)
    return data, raw, begins, sizes, np.flatnonzero(~space[1:] & space[:-1]) + 1


@dataclass
class Chunks:
    """An entry per chunk: the index of its text, its words, and its place in the buffer of the texts as they are
    (raw) and in that of their words joined by one space (data)."""

    raw: bytes
    data: bytes
    doc: np.ndarray
    words: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    begin: np.ndarray
    end: np.ndarray


def chunked(texts: list, bits: int = BITS, most_words: int = MOST_WORDS, gear: np.ndarray | None = None) -> Chunks:
    """The chunks of a list of texts, whose null ones count as empty. Leading white space belongs to no chunk;
    trailing white space belongs to the chunk before it. Texts without words have no chunks."""
    gear = gear_table() if gear is None else gear
    coded = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw, _, begins, sizes, places = laid_out(coded)
    data, seen, starts_at, lengths, starts = laid_out([b" ".join(c.split()) for c in coded])
    h = gear[seen]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint16(k)
    owner = np.searchsorted(starts_at, starts, side="right") - 1
    new_doc = np.ones(len(starts), bool)
    new_doc[1:] = owner[1:] != owner[:-1]
    cut = new_doc | (h[starts - 1] >> np.uint16(16 - bits) == 0)
    at = np.flatnonzero(cut)
    words = np.diff(np.append(at, len(starts)))
    if len(words) and words.max() > most_words:
        extra = [np.arange(a + most_words, a + n, most_words) for a, n in zip(at[words > most_words], words[words > most_words], strict=True)]
        at = np.sort(np.concatenate([at, *extra]))
        words = np.diff(np.append(at, len(starts)))
    doc = owner[at]
    last = np.ones(len(at), bool)
    last[:-1] = doc[1:] != doc[:-1]

    def stops(start: np.ndarray, ends: np.ndarray) -> np.ndarray:
        stop = np.append(start[1:], 0)[: len(start)]
        stop[last] = ends[doc[last]]
        return stop

    return Chunks(raw, data, doc, words, places[at], stops(places[at], begins + sizes), starts[at], stops(starts[at], starts_at + lengths))


def chunk_texts(texts: list, bits: int = BITS, most_words: int = MOST_WORDS, gear: np.ndarray | None = None):
    """`chunked` as (buffer, doc, start, stop, words): places are those in the texts as they are."""
    c = chunked(texts, bits, most_words, gear)
    return c.raw, c.doc, c.start, c.stop, c.words


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))


def chunks(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """digest, doc_id, h, at of every window of WINDOW chunks (of all chunks, where a text has fewer); h
    is the text's hash; at packs the number of the window's last chunk, the words of the window (12
    bits) and of that chunk (8 bits), so that it orders the windows of a document."""

    def run(batches):
        import xxhash

        digest, gear = xxhash.xxh3_64_intdigest, gear_table()
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                c = chunked(texts[a:b].to_pylist(), bits, gear=gear)
                data, doc, start, stop, words = c.data, c.doc, c.begin, c.end, c.words
                if not len(doc):
                    continue
                first = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                n = np.diff(np.append(first, len(doc)))
                number = np.arange(len(doc)) - np.repeat(first, n)
                full = (number >= WINDOW - 1) | (number == np.repeat(n, n) - 1)
                end = np.flatnonzero(full)
                begin = end - np.minimum(number[end], WINDOW - 1)
                total = np.append(0, np.cumsum(words))
                at = (number[end] << 20) | ((total[end + 1] - total[begin]) << 8) | words[end]
                values = np.array([digest(data[x:y].rstrip()) for x, y in zip(start[begin].tolist(), stop[end].tolist(), strict=True)], np.uint64).view(np.int64)
                rows = pa.array(doc[end] + a)
                yield pa.RecordBatch.from_arrays([pa.array(values), batch.column(0).take(rows), batch.column(2).take(rows), pa.array(at)], names=["digest", "doc_id", "h", "at"])

    return keyed(docs).select("doc_id", "text", "h").mapInArrow(run, "digest long, doc_id long, h long, at long")


def runs(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """The removals: doc_id, h, spans (array of first chunk, last chunk, words) of documents that have any.

    Repeats are decided on digests over all documents; the counts and first places are combined
    before the shuffle, so a digest that fills the corpus is one row a task.
    """
    windows = chunks(docs, bits)
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h", "at")
    repeated = windows.groupBy("digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    repeated = materialize(repeated.select(F.col("digest").alias("again"), "first"), "repeated")
    again = windows.join(repeated, windows["digest"] == repeated["again"]).filter(place != F.col("first"))
    listed = again.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set("at")).alias("ats"))

    def run(batches):
        for batch in batches:
            out = []
            flat, offsets = batch.column(2).values.to_numpy(), batch.column(2).offsets.to_numpy()
            for i in range(batch.num_rows):
                at = flat[offsets[i] : offsets[i + 1]]
                k, window, own = at >> 20, (at >> 8) & 0xFFF, at & 0xFF
                lo = np.append(0, np.flatnonzero(np.diff(k) != 1) + 1)
                hi = np.append(lo[1:], len(k)) - 1
                total = window[lo] - own[lo] + np.add.reduceat(own, lo)
                out.append([{"a": max(0, int(k[x]) - WINDOW + 1), "b": int(k[y]), "words": int(n)} for x, y, n in zip(lo, hi, total, strict=True) if n >= least])
            kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("words", pa.int64())]))
            keep = pa.array([bool(x) for x in out])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array([x for x in out if x], kind)], names=["doc_id", "h", "spans"])

    return materialize(listed.mapInArrow(run, "doc_id long, h long, spans array<struct<a long, b long, words long>>"), "runs")


def cleaned(docs: DataFrame, least: int = LEAST, bits: int = BITS) -> DataFrame:
    """doc_id, _text (without its repeats), removed_spans (code points start, stop), removed_words, and
    _row with docs' own columns.

    A null text stays null, and nothing is removed from it; the first occurrence is that of the
    smallest doc_id (null ids last), then the earliest in its text; rows equal in doc_id and text
    count as one document, so none is a repeat of the other (documents are told apart by doc_id and a 64-bit
    hash of the text); a very long text is chunked whole, in one task; columns of docs may have any
    names; an empty table gives no rows.
    """
    found = runs(docs, least, bits)
    size = found.agg(F.sum(32 + 24 * F.size("spans"))).first()[0] or 0
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("_old"))
    rows = rows.withColumn("_h", F.xxhash64(F.coalesce("_old", F.lit(""))))
    side = F.broadcast(found) if size <= BROADCAST_BYTES else found
    rows = rows.join(side, rows["_doc"].eqNullSafe(side["doc_id"]) & (rows["_h"] == side["h"]), "left").drop("doc_id", "h")

    def run(batches):
        for batch in batches:
            texts, spans = batch.column(batch.schema.get_field_index("_old")).to_pylist(), batch.column(batch.schema.get_field_index("spans")).to_pylist()
            new, removed, count = list(texts), [[] for _ in texts], [0] * len(texts)
            todo = [i for i, s in enumerate(spans) if s]
            for a, b in slices(pa.array([texts[i] for i in todo], pa.string())):
                own = todo[a:b]
                _, doc, start, stop, words = chunk_texts([texts[i] for i in own], bits)
                first = np.searchsorted(doc, np.arange(len(own)))
                for j, i in enumerate(own):
                    raw = texts[i].encode("utf-8", "surrogatepass")
                    base = start[first[j]] - (len(raw) - len(raw.lstrip()))
                    kept, at, chars, done = [], 0, 0, 0
                    for s in spans[i]:
                        x, y = max(at, int(start[first[j] + s["a"]] - base)), int(stop[first[j] + s["b"]] - base)
                        kept.append(raw[at:x])
                        chars += len(raw[at:x].decode("utf-8", "replace"))
                        gone = len(raw[x:y].decode("utf-8", "replace"))
                        removed[i].append({"start": chars, "stop": chars + gone})
                        chars, at = chars + gone, y
                        count[i] += int(words[first[j] + max(done, s["a"]) : first[j] + s["b"] + 1].sum())  # spans may overlap
                        done = s["b"] + 1
                    new[i] = (b"".join(kept) + raw[at:]).decode("utf-8", "replace")
            kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
            cols = [batch.column(batch.schema.get_field_index(c)) for c in ("_row", "_doc")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(new, pa.string()), pa.array(removed, kind), pa.array(count, pa.int64())], names=["_row", "doc_id", "_text", "removed_spans", "removed_words"])

    made = StructType.fromDDL("doc_id long, _text string, removed_spans array<struct<start long, stop long>>, removed_words long")
    kinds = StructType([rows.schema["_row"], *made])
    return rows.select("_row", "_doc", "_old", "spans").mapInArrow(run, kinds)


def report(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, text (without its repeats), removed_spans, removed_words of every document; see `cleaned`."""
    return cleaned(docs.select("doc_id", "text"), least).select("doc_id", F.col("_text").alias("text"), "removed_spans", "removed_words")


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """docs with the repeats taken out of their texts; documents left without words go. A column n_chars
    follows the text."""
    out = cleaned(docs, least).filter((F.col("removed_words") == 0) | F.col("_text").rlike(r"[^\x20\x09-\x0D]"))
    fields = [F.col("_text").cast(docs.schema["text"].dataType).alias(c) if c == "text" else F.coalesce(F.when(F.col("removed_words") > 0, F.length("_text").cast(docs.schema[c].dataType)), F.col("_row")[c]).alias(c) if c == "n_chars" else F.col("_row")[c].alias(c) for c in docs.columns]
    return out.select(*fields)
