"""Near copies by the Jaccard similarity of their word shingles.

A text is the set of hashes of its runs of five words; texts with equal sets are one node. SimHash fingerprints of the
sets are linked by their deletion-variant signatures (see `neardup`), and every member of a group is compared with the
group's smallest one: a pair counts after its whole sets have been compared. Fingerprints within three bits find what
is nearly the same. At a similarity of 0.8 some ten of the 64 bits differ, and no index of one-wildcard segments is
selective there, so MinHash bands propose the rest: of every key of the first bands all members are compared with the
smallest one, so a crowd of near copies soon is one group, for a row a member; then, in every key, the members outside
its largest group with one member of that; last, the pairs of a key that are still in different groups, if bitmaps of
their sets differ in few enough bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, slices, whole_row
from .components import components
from .neardup import links

#: Words of a shingle; the similarity of near copies as a fraction.
SHINGLE, LEAST = 5, (4, 5)
#: Bands and minima of each. A pair at similarity 0.8 shares no band in (1 - 0.8**6)**64 = 4e-9 of cases.
BANDS, ROWS = 64, 6
#: Bands that group crowds before the others are looked at. It changes no result.
EARLY = 3
#: Differing bits of linked fingerprints; tasks that share the comparisons with one node.
RADIUS, SALTS = 3, 32
#: Bits of a set's bitmap, in which every shingle flips the bit of its hash. Two bitmaps differ in no more bits than the
#: sets in shingles, which are at most a ninth of both sizes' sum at a similarity of 0.8.
BITMAP = 2048
_rng = np.random.default_rng(42)
_WORDS = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BANDS = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def mixed(x: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's runs of five words, lower-cased in A-Z; fewer words are one run."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(SHINGLE, len(own))
    total = np.full(len(own) - k + 1, k, np.uint64)
    for i in range(k):
        total += own[i : i + len(total)] * _WORDS[i]
    return np.unique(mixed(total))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key (signed long) for every band of minima of a set that is not empty."""
    short = (own >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(_BANDS), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, (_BANDS[:, None] * short[None, at : at + 1024]).min(1), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view("<i8")


def fingerprint(own: np.ndarray) -> int:
    """The SimHash of a set, as a signed long: a bit is 1 if it is set in over half of the hashes; 0 for an empty set."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(own), 1 << 15):
        votes += np.unpackbits(own[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(own), bitorder="little").view("<i8")[0])


def bitmap(own: np.ndarray) -> np.ndarray:
    """A set's bitmap, as signed longs."""
    odd = np.bincount((own % np.uint64(BITMAP)).astype(np.int64), minlength=BITMAP) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view("<i8")


def bitmaps(sets: DataFrame) -> DataFrame:
    """s, bits of sets (s, own)."""

    def run(batches):
        for batch in batches:
            bits = pa.array([bitmap(np.frombuffer(x.as_buffer(), "<u8")) for x in batch.column(1)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["s", "bits"])

    return sets.mapInArrow(run, "s long, bits array<long>")


def few_bits(a: str, b: str) -> str:
    """A condition on rows a and b (n, bits) that no pair at similarity 0.8 fails but one in 1e9: not more bits differ
    than shingles may, nor than 6 standard deviations over what so many flips come to, where flips meet."""
    differ = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(BITMAP // 64))
    most = f"({a}.n + {b}.n) / 9.0"
    return f"{differ} <= least({most}, {BITMAP / 2} * (1 - pow({1 - 2 / BITMAP}, {most})) + {3 * BITMAP**0.5})"


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (a hash of the text), s (a hash of the set), n (its size), fp (its fingerprint), keys of every row."""

    def run(batches):
        import xxhash

        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                own = [shingles(t) for t in texts[a:b].to_pylist()]
                s = np.array([xxhash.xxh64_intdigest(x.tobytes(), 7) for x in own], "<u8").view("<i8")
                n = pa.array([len(x) for x in own], pa.int64())
                fp = pa.array([fingerprint(x) for x in own], pa.int64())
                keys = pa.array([band_keys(x) if len(x) else [] for x in own], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(2)[a:b], pa.array(s), n, fp, keys], names=["doc_id", "h", "s", "n", "fp", "keys"])

    return keyed(docs).mapInArrow(run, "doc_id long, h long, s long, n long, fp long, keys array<long>")


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """s, n, rep (a struct of s and n): the classes (s, n, fp) of every group of fingerprints that deletion-variant signatures
    link, but its smallest one, which is rep."""
    found = classes.filter("n > 0").select("s", "n", "fp")
    joined = components(links(found.select("fp").distinct(), RADIUS))
    groups = found.join(joined, found["fp"] == joined["node"], "left").select("s", "n", F.coalesce("component", "fp").alias("group"))
    groups = materialize(groups, "fingerprints")
    reps = groups.groupBy("group").agg(F.min(F.struct("s", "n")).alias("rep"), F.count("*").alias("c")).filter("c > 1").select("group", "rep")
    return groups.join(materialize(reps, "representatives"), "group").filter("s <> rep.s").select("s", "n", "rep")


def keyed(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.select("doc_id", "text", F.xxhash64("text").alias("h"))


def whole_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """s, own (the set's hashes as bytes) of nodes (s, doc_id, h: a row that has the set)."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in slices(texts):
                own = pa.array([shingles(t).tobytes() for t in texts[a:b].to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], own], names=["s", "own"])

    rows, wanted = keyed(docs), nodes.select("s", F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = rows.join(wanted, rows["doc_id"].eqNullSafe(wanted["_id"]) & (rows["h"] == wanted["_h"]))
    rows = rows.groupBy("s").agg(F.min("text").alias("text"))  # repeated rows
    return rows.mapInArrow(run, "s long, own binary")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more."""

    def run(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), "<u8") for c in (2, 3))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(LEAST[1] * both >= LEAST[0] * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    one, two = sets.select(F.col("s").alias("a"), F.col("own").alias("x")), sets.select(F.col("s").alias("b"), F.col("own").alias("y"))
    pairs = materialize(pairs.withColumn("salt", F.pmod("b", F.lit(SALTS))), "pairs")
    one = pairs.select("a", "salt").distinct().join(one, "a")  # a copy for each salt that occurs
    return pairs.join(two, "b").join(one, ["a", "salt"]).select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, h, s, component_id, keep_h of every row; see `neardup.grouped`, with similarity 0.8 of five-word
    shingles for links. Texts without words are one group; null texts count as empty; a very long text's set is in
    one task's memory, 8 bytes a word; repeated rows share their set; an empty table gives no rows."""
    rows = materialize(sketches(docs), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("first")
    classes = materialize(rows.groupBy("s").agg(first, F.max("n").alias("n"), F.any_value("fp").alias("fp"), F.any_value("keys").alias("keys")), "classes")
    index = classes.select("s", "n", F.posexplode("keys").alias("band", "key"))
    shared = index.groupBy("key").agg(F.count("*").alias("members")).filter("members > 1").select("key")
    members = materialize(index.hint("merge").join(shared, "key"), "members")  # never broadcast: its size is estimated without the bands
    alike = materialize(by_fingerprint(classes), "alike")
    asked = members.select("s").union(alike.select("s")).union(alike.select("rep.s")).distinct()
    nodes = classes.join(asked, "s").select("s", "first.doc_id", "first.h")
    sets = materialize(whole_sets(docs, nodes), "sets")

    close = lambda x, y: F.expr(f"{LEAST[1]} * least({x}, {y}) >= {LEAST[0]} * greatest({x}, {y})")  # noqa: E731  (sizes alone rule it out)
    rep = F.struct("s", "n")
    early = members.filter(F.col("band") < EARLY)
    star = early.join(early.groupBy("key").agg(F.min(rep).alias("rep")), "key").filter("s <> rep.s").select("s", "n", "rep")
    star = alike.union(star).filter(close("n", "rep.n"))
    near = materialize(verified(star.select(F.col("rep.s").alias("a"), F.col("s").alias("b")).distinct(), sets), "near")

    def with_roots(some: DataFrame) -> DataFrame:
        joined = components(near)
        return some.join(joined, some["s"] == joined["node"], "left").select("key", "s", "n", F.coalesce("component", "s").alias("root"))

    known = materialize(with_roots(members), "known")
    largest = known.groupBy("key", "root").agg(F.count("*").alias("c"), F.min(rep).alias("rep"))
    largest = largest.groupBy("key").agg(F.count("*").alias("roots"), F.max(F.struct("c", "root", "rep")).alias("l")).filter("roots > 1")
    open_ = materialize(known.join(largest.select("key", F.col("l.root").alias("main"), F.col("l.rep").alias("rep")), "key"), "open")
    star = open_.filter("root <> main").filter(close("n", "rep.n")).select(F.col("rep.s").alias("a"), F.col("s").alias("b")).distinct()
    near = materialize(near.union(verified(star, sets)), "near")

    open_ = with_roots(open_.select("key", "s", "n"))
    mixed_keys = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    open_ = materialize(open_.join(mixed_keys, "key"), "open")
    bits = materialize(bitmaps(sets.join(open_.select("s").distinct(), "s", "left_semi").select("s", "own")), "bitmaps")
    open_ = open_.join(bits, "s")
    p, q = open_.alias("p"), open_.alias("q")
    rest = p.join(q, F.expr("p.key = q.key and p.s < q.s and p.root <> q.root") & close("p.n", "q.n") & F.expr(few_bits("p", "q")))
    rest = rest.select(F.col("p.s").alias("a"), F.col("q.s").alias("b")).distinct()
    joined = components(near.union(verified(rest, sets)))

    named = classes.join(joined, classes["s"] == joined["node"], "left").select("s", "first", F.coalesce("component", "s").alias("root"))
    heads = named.groupBy("root").agg(F.min("first").alias("first"))
    named = materialize(named.select("s", "root").join(heads, "root").select("s", F.col("first.doc_id").alias("component_id"), F.col("first.h").alias("keep_h")), "named")
    return rows.select("doc_id", "h", "s").join(named, "s").select("doc_id", "h", "s", "component_id", "keep_h")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each group: the one with the smallest doc_id (see `grouped`)."""
    keep = materialize(grouped(docs).select(F.col("component_id").alias("_id"), F.col("keep_h").alias("_h")).distinct(), "kept")
    rows = docs.select(whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_doc"), F.xxhash64(F.col("text").cast("string")).alias("_hash"))
    rows = rows.join(keep, rows["_doc"].eqNullSafe(keep["_id"]) & (rows["_hash"] == keep["_h"]), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_doc", "_hash").orderBy(F.lit(0)))
    return rows.withColumn("_nth", nth).filter("_nth = 1").select("_row.*")
