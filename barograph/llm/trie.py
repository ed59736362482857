"""A prefix trie of conversations, built by fingerprints of all prefixes.

Turns lie in ranges of (conversation, turn), so that a conversation of any length is dealt to several tasks. Each
task scans its turns once, in numpy, for their places and the polynomial fingerprints of the prefixes they end; what
a conversation has in the ranges before is added from one row a range. Turns of equal depth and fingerprint are
candidates for one node. In every such group the members' last turns are compared with those of the member with the
smallest conversation, as texts, and so are the nodes above; as all depths are verified, equal nodes above and equal
last turns mean equal prefixes. Members that differ leave for a group of their own, until none does.

No level is rolled up by itself. A node's representative is one for all deeper nodes of its path that it represents,
so sums over subtrees are sums over the representatives' paths: each path carries suffix sums to the nodes it passes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, remove, stored

#: The primes of the two halves of a fingerprint, and their bases.
PRIMES, BASES = (2147483647, 2147483629), (1000003, 998244353)
#: Shared turns are looked up in blocks of this many conversations; ids of ends are gathered in such ranges too.
BLOCK, RANGE = 20, 4096


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; null role and text are empty. Rows without a conv_id are of no conversation and go."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    return conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo p, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), p) % p])
    return out[:n]


def _scan(hashes: np.ndarray, starts: np.ndarray, carry: tuple[int, int], p: int, base: int) -> np.ndarray:
    """Prefix fingerprints sum of h_i base^(i-1) mod p, i from 1 in each conversation; starts: each row's first row.
    Rows before the first start continue a conversation with carry[0] turns and the fingerprint carry[1]."""
    place = np.arange(len(hashes)) - starts + np.where(starts == 0, carry[0], 0)
    terms = (hashes % np.uint64(p)).astype(np.int64) * _powers(base, p, int(place.max(initial=0)) + 1)[place] % p
    terms[:1] += carry[1]
    upto = np.cumsum(terms)
    before = np.where(starts > 0, upto[starts - 1], 0)
    return (upto - before) % p


def scanned(turns: DataFrame, order: list[str], primes: tuple[int, int] = PRIMES) -> tuple[DataFrame, str]:
    """turns (conv_id, ..., h: the last turn's hash) stored with d (its place in the conversation, from 1), f (the
    fingerprint of the first d turns), up (of the first d - 1, 0 for none) and part, the range it lies in; the path."""
    columns = turns.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema if f.name != "h") + ", n long, f1 long, f2 long, b1 long, b2 long"

    def run(batches):
        last, n, f = None, 0, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            new = np.flatnonzero(np.diff(conv)) + 1
            starts = np.zeros(len(conv), np.int64)
            starts[new] = new
            starts = np.maximum.accumulate(starts)
            if conv[0] != last:
                n, f = 0, [0, 0]
            h = batch.column("h").to_numpy().view(np.uint64)
            own = [_scan(h, starts, (n, f[k]), primes[k], BASES[k]) for k in range(2)]
            place = np.arange(len(conv)) - starts + 1 + np.where(starts == 0, n, 0)
            above = []
            for k in range(2):
                b = np.concatenate([[f[k]], own[k][:-1]])
                b[new] = 0
                above.append(b)
            last, n, f = conv[-1], int(place[-1]), [int(own[0][-1]), int(own[1][-1])]
            kept = [c for c in columns if c != "h"]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(x) for x in (place, *own, *above)], names=[*kept, "n", "f1", "f2", "b1", "b2"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)
    local, path = stored(ranged.withColumn("part", F.spark_partition_id()), "scanned")
    before = F.broadcast(_carries(local, primes))  # two rows a range at most
    met = local.join(before, ["conv_id", "part"], "left")
    out = {"d": F.col("n") + F.coalesce("c", F.lit(0))}
    for k, p in enumerate(primes, 1):
        weight, carry = F.coalesce(f"w{k}", F.lit(1)), F.coalesce(f"g{k}", F.lit(0))
        out |= {f"x{k}": (F.col(f"f{k}") * weight + carry) % p, f"y{k}": (F.col(f"b{k}") * weight + carry) % p}
    met = met.withColumns(out)
    f, up = (F.shiftleft(f"{c}1", 31).bitwiseOR(F.col(f"{c}2")) for c in "xy")
    kept = [c for c in columns if c != "h"]
    return met.select(*kept, "d", f.alias("f"), F.when(F.col("d") == 1, 0).otherwise(up).cast("long").alias("up"), "part"), path


def _carries(local: DataFrame, primes: tuple[int, int]) -> DataFrame:
    """conv_id, part, c, g1, g2, w1, w2 of conversations that lie in several ranges: turns and fingerprint before the
    range, and the weights of its first turn."""
    ends = local.groupBy("conv_id", "part").agg(F.max("n").alias("n"), F.max_by("f1", "n").alias("f1"), F.max_by("f2", "n").alias("f2"))
    ends = ends.withColumn("_parts", F.count("*").over(Window.partitionBy("conv_id"))).filter("_parts > 1").drop("_parts")

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, c, g = rows.sort_values("part"), [], 0, [0, 0]
        for conv, part, n, *f in rows[["conv_id", "part", "n", "f1", "f2"]].itertuples(index=False):
            w = [pow(BASES[k], c, primes[k]) for k in range(2)]
            out.append((conv, part, c, *g, *w))
            g = [(g[k] + f[k] * w[k]) % primes[k] for k in range(2)]
            c += n
        return pd.DataFrame(out, columns=["conv_id", "part", "c", "g1", "g2", "w1", "w2"])

    return ends.groupBy("conv_id").applyInPandas(run, "conv_id long, part int, c long, g1 long, g2 long, w1 long, w2 long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, seq, role, text) of conversations rebuilt with a shared start, in the order of seq, and all
    conv_ids. Conversation c, h being crc32 of its decimal number modulo 4, begins with the first h turns of
    conversation c - c % 20 (% as in SQL), all if it has fewer, none if there is no such; its own turns after its first
    h follow. Turns are ordered by turn (null first), then role, then text, repeated ones being turns of their own."""
    turns = conversation_turns(conversations)
    own, _ = scanned(turns.withColumn("h", F.lit(0).cast("long")), ["conv_id", "turn", "role", "text"])
    own = own.select("conv_id", F.col("d").alias("seq"), "role", "text")
    convs = materialize(turns.select("conv_id").distinct(), "conversations")
    taken = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("long")
    base = (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("_base")
    heads = own.filter((F.col("seq") <= 3) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "_from")
    heads = convs.select("conv_id", base, taken.alias("_h")).join(heads, F.col("_base") == F.col("_from")).filter("seq <= _h")
    return heads.select("conv_id", "seq", "role", "text").unionByName(own.filter(F.col("seq") > taken)), convs


def _grouped(turns: DataFrame) -> DataFrame:
    """d, g, conv_id (the smallest member), n, up, words of every group of turns."""
    return turns.groupBy("d", "g").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.min("up").alias("up"), F.max("words").alias("words"))


def verified(turns: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, d, g, up, words, part) and their groups, after members that differ from their group's
    smallest, in the last turn or in the group above, have left for groups of their own. turns: conv_id, d, role, text,
    g, up, words, part, read from path; a round that moves nothing ends the work, mostly the first."""
    spark = turns.sparkSession
    while True:
        groups, groups_path = stored(_grouped(turns), "groups")
        many = groups.filter("n > 1").select("d", "g", F.col("conv_id").alias("rep"))
        shared, shared_path = stored(turns.join(many, ["d", "g"]).select("conv_id", "rep", "d", "g", "up", "role", "text"), "shared")
        rep = shared.filter("conv_id = rep").select("d", "g", F.col("up").alias("_up"), F.col("role").alias("_role"), F.col("text").alias("_text"))
        met = shared.filter("conv_id <> rep").join(rep, ["d", "g"])
        bad, bad_path = stored(met.filter("up <> _up or role <> _role or text <> _text").select("conv_id", "d", F.xxhash64("d", "g", F.lit("apart")).alias("_new")), "apart")
        remove(spark, shared_path)
        if bad.isEmpty():
            remove(spark, bad_path)
            return turns.select("conv_id", "d", "g", "up", "words", "part"), groups
        own = turns.join(bad, ["conv_id", "d"], "left").withColumn("g", F.coalesce("_new", "g")).drop("_new")
        above = bad.select("conv_id", (F.col("d") + 1).alias("d"), F.col("_new"))
        own = own.join(above, ["conv_id", "d"], "left").withColumn("up", F.coalesce("_new", "up")).drop("_new")
        turns, new_path = stored(own.select(*turns.columns), "turns")
        for p in (path, groups_path, bad_path):
            remove(spark, p)
        path = new_path


def _joined_ids(ends: DataFrame) -> DataFrame:
    """d, g, ends_sha256 of nodes where conversations end. Of a node with many, ids are gathered in ranges of numbers;
    one task then hashes the node's ranges in order, as a stream."""
    sized = ends.groupBy("d", "g").agg(F.count("*").alias("n"), F.min("conv_id").alias("one"))
    alone = sized.filter("n = 1").select("d", "g", F.sha2(F.col("one").cast("string").cast("binary"), 256).alias("ends_sha256"))
    some = ends.groupBy("d", "g", F.floor(F.col("conv_id") / RANGE).alias("k")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))  # RANGE at most
    some = some.join(sized.filter("n > 1").select("d", "g"), ["d", "g"], "left_semi").select("d", "g", "k", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))

    def run(batches):
        node, sha = None, None
        for batch in batches:
            out = []
            for d, g, ids in zip(batch.column("d").to_pylist(), batch.column("g").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if (d, g) != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (d, g), hashlib.sha256(ids.encode())
                else:
                    sha.update(f",{ids}".encode())
            yield _digests(out)
        if node:
            yield _digests([(*node, sha.hexdigest())])

    streams = some.repartition("d", "g").sortWithinPartitions("d", "g", "k").mapInArrow(run, "d long, g long, ends_sha256 string")
    return alone.unionByName(streams)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"d": pa.int64(), "g": pa.int64(), "ends_sha256": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds.values())], names=list(kinds))


def _suffix_sums(paths: DataFrame, *values: str) -> DataFrame:
    """paths (conv_id, d, part, ...) with each value summed over the conversation's rows from this one on: inside a
    range by a window, behind it from one row a range."""
    here = Window.partitionBy("conv_id", "part").orderBy(F.col("d").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = paths.groupBy("conv_id", "part").agg(*[F.sum(v).alias(v) for v in values]).withColumn("_parts", F.count("*").over(Window.partitionBy("conv_id"))).filter("_parts > 1")
    behind = Window.partitionBy("conv_id").orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    behind = parts.select("conv_id", "part", *[F.sum(v).over(behind).alias(f"_{v}") for v in values])
    met = paths.join(F.broadcast(behind), ["conv_id", "part"], "left")  # two rows a range at most
    return met.withColumns({v: F.sum(v).over(here) + F.coalesce(f"_{v}", F.lit(0)) for v in values}).drop(*[f"_{v}" for v in values])


def nodes(turns: DataFrame, convs: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """The trie of turns (conv_id, seq, role, text), ordered by seq in each conversation; convs (conv_id) has all
    conversations, also those without turns. Per node: conv_id (the smallest member), depth, parent_conv_id (NULL for
    the root), n_convs, n_children, n_leaves (childless nodes in its subtree, itself included), saved_tokens (over
    its subtree: (n_convs - 1) times the words of the node's last text) and ends_sha256 (of the decimal conv_ids that
    end there, in numerical order, joined by commas; of the empty string where none does). Texts of any length are
    compared whole. Without conversations there are no rows, not even the root."""
    hashed = turns.withColumns({"words": F.regexp_count("text", F.lit(WORD)).cast("long"), "h": F.xxhash64("role", "text")})
    found, path = scanned(hashed, ["conv_id", "seq"], primes)
    found, local = stored(found.withColumnRenamed("f", "g"), "turns")
    remove(turns.sparkSession, path)
    slim, groups = verified(found, local)
    lengths = materialize(convs.join(slim.groupBy("conv_id").agg(F.max("d").alias("d"), F.max_by("g", "d").alias("g")), "conv_id", "left").select("conv_id", F.coalesce("d", F.lit(0)).cast("long").alias("d"), F.coalesce("g", F.lit(0)).cast("long").alias("g")), "lengths")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n")).filter("n > 0").select(zero.alias("d"), zero.alias("g"), "conv_id", "n", F.lit(None).cast("long").alias("up"), zero.alias("words"))
    every = groups.select("d", "g", "conv_id", "n", "up", "words").unionByName(root)
    children = groups.groupBy((F.col("d") - 1).alias("d"), F.col("up").alias("g")).agg(F.count("*").alias("n_children"))
    every = materialize(every.join(children, ["d", "g"], "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    own = F.col("conv_id") == F.col("rep")
    saved, leaf = F.when(own, (F.col("n") - 1) * F.col("words")).otherwise(zero), F.when(own & (F.col("n_children") == 0), 1).otherwise(0).cast("long")
    reps = every.filter("d > 0").select("d", "g", F.col("conv_id").alias("rep"), "n", "n_children")
    paths = slim.join(every.filter("d > 0").select("conv_id").distinct(), "conv_id", "left_semi").join(reps, ["d", "g"])
    paths = _suffix_sums(materialize(paths.select("conv_id", "d", "g", "part", saved.alias("saved"), leaf.alias("leaf")), "paths"), "saved", "leaf")
    below = paths.groupBy("d", "g").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    whole = every.agg(F.sum(F.when(F.col("d") > 0, (F.col("n") - 1) * F.col("words")).otherwise(zero)).alias("saved_tokens"), F.count(F.when(F.col("n_children") == 0, 1)).alias("n_leaves"))
    below = below.unionByName(whole.select(zero.alias("d"), zero.alias("g"), F.coalesce("saved_tokens", zero).alias("saved_tokens"), "n_leaves"))

    above = every.select((F.col("d") + 1).alias("d"), F.col("g").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    out = every.join(below, ["d", "g"], "left").join(_joined_ids(lengths), ["d", "g"], "left").join(above, ["d", "up"], "left")
    return out.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def report(conversations: DataFrame, primes: tuple[int, int] = PRIMES) -> DataFrame:
    """`nodes` of the conversations that `rebuilt` makes of a table. Other columns than conv_id, turn, role and text
    are ignored; rows without a conv_id take no part; an empty table gives no rows."""
    turns, convs = rebuilt(conversations)
    return nodes(turns, convs, primes)
