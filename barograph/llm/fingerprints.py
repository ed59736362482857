"""SimHash document fingerprints in DataFrame functions only.

Terms are pairs of neighbouring words (the word alone in a text of one), weighted by how often they
occur. Every term's 64-bit hash votes on each bit; a fingerprint bit is 1 if over half of the weight
has it set. Votes are added as four 16-bit lanes in each of 16 longs, over stretches of a text that
are too short for a lane to run over.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, materialize, numbered

#: Terms added up in one stretch (a lane counts to 65535, the topmost to 32767).
STRETCH = 30_000
#: What names a text: whether it has an id, the id (0 without one), a hash of the text, its code points.
KEY = ["_known", "_id", "_tie", "_size"]
_LANES = 0x0001000100010001


def term_hashes(words: Column) -> Column:
    """The hashes of a text's terms, as often as they occur. (xxhash64 passes over nulls, so a single
    word is hashed alone.)"""
    last = F.greatest(F.size(words) - 1, F.lit(1))
    return F.zip_with(F.slice(words, F.lit(1), last), F.slice(words, F.lit(2), last), lambda a, b: F.xxhash64(a, b))


def words_array(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def sums(rows: DataFrame, keys: list[str], kinds: Column) -> DataFrame:
    """keys, _e and _fp (signed 64-bit) from rows of keys, _hashes and what kinds reads: the place _at of a hash
    gives the list of the _e it votes for. keys name a row."""
    each = rows.select("*", F.posexplode_outer("_hashes").alias("_at", "_h")).withColumn("_for", kinds)
    lanes = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_LANES))).alias(f"_l{i}") for i in range(16)]
    votes = each.groupBy(*keys, "_for", F.floor(F.col("_at") / STRETCH).alias("_stretch")).agg(F.count("_h").alias("_n"), *lanes)
    votes = votes.select("*", F.explode("_for").alias("_e"))
    bits = [F.sum(F.shiftrightunsigned(f"_l{i % 16}", 16 * (i // 16)).bitwiseAND(F.lit(0xFFFF))).alias(f"_b{i}") for i in range(64)]
    votes = votes.groupBy(*keys, "_e").agg(F.sum("_n").alias("_n"), *bits)
    fp = F.lit(0).cast("long")
    for i in range(64):
        one = (1 << i) if i < 63 else -(1 << 63)
        fp = fp.bitwiseOR(F.when(2 * F.col(f"_b{i}") > F.col("_n"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, "_e", fp.alias("_fp"))


def fingerprint(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and _fp (signed 64-bit) for every row of (keys, text); keys name a row."""
    hashed = rows.select(*keys, term_hashes(words_array(F.col(text))).alias("_hashes"))
    return sums(hashed, keys, F.array(F.lit(0))).drop("_e")


def both_fingerprints(rows: DataFrame, keys: list[str], kept: str) -> DataFrame:
    """keys, fp, edited_fp for rows of keys, text, edited; both texts begin with the first `kept` code points. Terms
    within these are hashed and counted once for both."""
    words = rows.select(*keys, words_array(F.col("text")).alias("_w"), words_array(F.col("edited")).alias("_v"), F.regexp_count(F.substring(F.col("text"), F.lit(1), F.col(kept)), F.lit(WORD)).alias("_whole"))
    # the last word of the beginning may go on; _m pairs lie before it
    words = words.withColumn("_m", F.greatest(F.col("_whole") - 2, F.lit(0))).withColumn("_t", term_hashes(F.col("_w")))
    tail = F.slice("_v", F.col("_m") + 1, F.greatest(F.size("_v"), F.lit(1)))
    rest = F.when((F.col("_m") > 0) & (F.size("_v") == F.col("_m") + 1), F.array().cast("array<bigint>")).otherwise(term_hashes(tail))
    hashed = words.select(*keys, "_m", F.size("_t").alias("_own"), F.concat("_t", rest).alias("_hashes"))
    kinds = F.when(F.col("_at") < F.col("_m"), F.array(F.lit(0), F.lit(1))).when(F.col("_at") < F.col("_own"), F.array(F.lit(0))).when(F.col("_at").isNotNull(), F.array(F.lit(1)))
    made = sums(hashed, keys, F.coalesce(kinds, F.array(F.lit(0), F.lit(1))))
    of = lambda e: F.coalesce(F.max(F.when(F.col("_e") == e, F.col("_fp"))), F.lit(0).cast("long"))
    return made.groupBy(*keys).agg(of(0).alias("fp"), of(1).alias("edited_fp"))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits, 0 to 1."""
    return 1.0 - F.bit_count(a.bitwiseXOR(b)) / 64.0


def within(fps: DataFrame, radius: int = 3, blocks: int = 5) -> DataFrame:
    """All pairs a < b of distinct fingerprints (column fp) that differ in 1 to radius bits.

    The 64 bits are cut into `blocks`; at most radius of them differ, so two such fingerprints agree
    in blocks - radius of them. There is a table for every choice of that many blocks: the bits are
    permuted to bring these to the front, which are the key; equal keys meet and are verified in
    the join. A pair is accepted in the first table where its blocks agree.
    """
    if not 0 < radius < blocks:
        raise ValueError("radius must be at least 1 and less than blocks")
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    tables = [signed(sum(masks[i] for i in chosen)) for chosen in combinations(range(blocks), blocks - radius)]
    listed = F.array(*[F.lit(m).cast("long") for m in tables])
    index = fps.select("fp").distinct().select("fp", F.posexplode(listed).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    a, b = index.alias("a"), index.alias("b")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    first = F.lit(len(tables))
    for t in reversed(range(len(tables))):
        first = F.when(differ.bitwiseAND(F.lit(tables[t]).cast("long")) == 0, F.lit(t)).otherwise(first)
    accept = (F.col("a.t") == F.col("b.t")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(differ) <= radius) & (first == F.col("a.t"))
    return a.join(b, accept).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """KEY, text, _copies: documents with equal ids and texts are one row."""
    doc_id, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc_id.isNotNull().alias("_known"), F.coalesce(doc_id, F.lit(0)).alias("_id"), text.alias("text"))
    rows = rows.select("_known", "_id", F.xxhash64("text").alias("_tie"), F.length("text").alias("_size"), "text")
    return rows.groupBy(*KEY).agg(F.first("text").alias("text"), F.count("*").alias("_copies"))


def followed(texts: DataFrame) -> DataFrame:
    """KEY, _copies and next, the KEY of the text that follows: null ids first, then by id, equal ids by a hash of their text; the
    first follows the last. Only keys are ordered, in ranges; the one window over the table has a row a range."""
    stored = numbered(texts.select(*KEY, "_copies"), *KEY, name="order")
    order = Window.orderBy("_part")
    key = F.struct(*KEY)
    heads = stored.filter("_at = 0").select("_part", key.alias("_head"))
    first = F.first("_head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_part", F.coalesce(F.lead("_head").over(order), first).alias("_after"))
    lead = F.lead(key).over(Window.partitionBy("_part").orderBy("_at"))
    linked = stored.withColumn("next", lead).join(after, "_part").select(*KEY, "_copies", F.coalesce("next", "_after").alias("next"))
    return materialize(linked, "followed")


def report(docs: DataFrame, radius: int = 3) -> DataFrame:
    """Fingerprints of every document and of its edited text, in which the last quarter of the code
    points is replaced by the first as many of the next document.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and
    near_links: how many other distinct fingerprints of documents are within radius bits. Texts
    without words have fingerprint zero, null texts count as empty, null ids come first, repeated
    rows follow one another, a single document is its own next; very long texts are taken whole, their
    votes in stretches; other columns are ignored; an empty table gives no rows.

    Texts meet the beginning of the next one by equality of keys; rows of one id are spread by
    their texts, and rows equal in both are worked on once.
    """
    texts = distinct_texts(docs)
    linked = followed(texts)
    texts = texts.drop("_copies")  # both joins then read one shuffle of the texts
    quarter = F.floor(F.col("_size") / 4).cast("int")
    # a text's beginning, sent to the text before it
    wanted = linked.select(*[F.col(f"next.{k}").alias(k) for k in KEY], F.struct(*KEY).alias("_to"), quarter.alias("_quarter"), "_copies")
    sent = texts.join(wanted, KEY).select(*[F.col(f"_to.{k}").alias(k) for k in KEY], F.substring(F.col("text"), F.lit(1), F.col("_quarter")).alias("_head"), "_copies")
    rows = texts.join(sent, KEY)
    # of several copies all but the last are followed by a copy
    last = F.struct(F.lit(True).alias("last"), F.lit(1).cast("long").alias("times"), F.col("_head").alias("head"))
    others = F.struct(F.lit(False).alias("last"), (F.col("_copies") - 1).alias("times"), F.substring(F.col("text"), F.lit(1), quarter).alias("head"))
    rows = rows.select(*KEY, "text", F.explode(F.when(F.col("_copies") > 1, F.array(last, others)).otherwise(F.array(last))).alias("_v"))
    kept = F.col("_size") - quarter
    edited = F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("_v.head"))
    rows = rows.select(*KEY, F.col("_v.last").alias("last"), F.col("_v.times").alias("times"), kept.alias("_kept"), "text", edited.alias("edited"))
    keys = [*KEY, "last", "times", "sha", "_kept"]
    rows = rows.withColumn("sha", F.unhex(F.sha2(F.col("edited").cast("binary"), 256)))
    own = materialize(both_fingerprints(rows, keys, "_kept"), "fingerprints")

    pairs = within(own.select("fp"), radius)
    links = materialize(pairs.select("a").union(pairs.select("b")).groupBy(F.col("a").alias("linked")).agg(F.count("*").alias("near_links")), "links")
    fps = own.filter("last").select(F.struct(*KEY).alias("next"), F.col("fp").alias("_next"))
    own = own.join(linked.join(fps, "next").select(*KEY, "_next"), KEY).withColumn("_next", F.when(F.col("last"), F.col("_next")).otherwise(F.col("fp")))
    own = own.join(links, own["fp"] == links["linked"], "left")
    # as many rows as there are copies, at most 4096 in one array
    own = own.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / 4096))).alias("_g"))
    own = own.select("*", F.explode(F.array_repeat(F.lit(0), F.least(F.lit(4096), F.col("times") - 4096 * F.col("_g")).cast("int"))).alias("_one"))
    return own.select(
        F.when(F.col("_known"), F.col("_id")).alias("doc_id"),
        F.col("_size").cast("long").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        hex16(F.col("fp")).alias("fingerprint"),
        hex16(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("_next")).alias("near_next"),
        F.coalesce("near_links", F.lit(0)).cast("long").alias("near_links"),
    )
