"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target in words. A document's expected copies grow mildly with its length (the
tilt) and add up to the target; their whole part is taken for certain. The fractions are inclusion
probabilities: documents are ranked by their random odds over their inclusion odds, and the
lowest-ranked are taken until the source's remaining words are reached.

The ranking is never sorted as a whole: a histogram of the ranks gives the bin in which a source's
target falls, and only that bin is ordered to find the exact cut. All decisions are functions of a
row's own columns, of its number among rows equal to it, and of small tables by source and length class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, numbered, part_starts, whole_row

WEIGHTS, SHARE, MOST, TILT = (5, 2, 1), 1.5, 2, 0.25
#: Bins of the ranks' logarithms a unit; a bin has at most a 4096th of a source's documents.
BINS = 1024
#: Rows of a plan up to which it is broadcast (about 100 bytes each, but for sources' names); longer plans are
#: joined by shuffle.
BROADCAST_ROWS = 100_000
#: Repeats of a row that one task numbers.
CHUNK = 65_536


def waterfill(df: DataFrame, by: list[str], weight: Column, cap: Column, budget: Column, name: str) -> DataFrame:
    """Adds name: the share of budget by weight within each group, where shares above cap stop there
    and the excess goes to the others by weight. Groups are small tables (sources, length classes)."""
    order = Window.partitionBy(*by).orderBy("_ratio", "_nth")
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    df = df.withColumn("_w", weight.cast("double")).withColumn("_cap", cap.cast("double")).withColumn("_budget", budget.cast("double"))
    df = df.withColumn("_ratio", F.when(F.col("_w") > 0, F.col("_cap") / F.nullif(F.col("_w"), F.lit(0.0))).otherwise(F.lit(0.0)))
    df = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy("_ratio")))
    df = df.withColumn("_level", F.try_divide(F.col("_budget") - (F.sum("_cap").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_cap")), F.sum("_w").over(rest)))
    first = F.min(F.when(F.col("_level") < F.col("_ratio"), F.struct("_nth", "_level"))).over(Window.partitionBy(*by))
    level = F.coalesce(first["_level"], F.when(F.col("_budget") > 0, F.lit(float("inf"))).otherwise(F.lit(0.0)))
    df = df.withColumn(name, F.when(F.col("_w") > 0, F.least(F.col("_cap"), level * F.col("_w"))).otherwise(F.lit(0.0)))
    return df.drop("_w", "_cap", "_budget", "_ratio", "_nth", "_level")


def level(df: DataFrame, weight: Column, cap: Column, budget: float) -> float:
    """The level at which least(cap, level * weight) adds up to budget (infinite where all caps do not reach it):
    what is above its cap is taken out until nothing more is. Every step is one sum over df."""
    over, now = -1, 0.0
    while True:
        full = cap <= F.lit(now) * weight
        r = df.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(weight)), F.count(F.when(full, 1))).first()
        if r[2] == over:
            return now
        over, now = r[2], (budget - r[0]) / r[1] if r[1] else float("inf")


def random(h: Column) -> Column:
    return (h.bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + 0.5) / float(1 << 52)


def measured(docs: DataFrame, seed: int) -> DataFrame:
    """doc_id, _key (orders sources by code point, null last), _size in words, _class of its length, and a hash _h
    of all that decides, from which the row's random number comes."""
    text, source = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("source").cast("string")
    key = F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col("doc_id"), key, text)
    return docs.withColumns({"_key": key, "_size": size, "_h": h}).withColumn("_class", F.floor(F.log2(F.col("_size") + 1)).cast("int"))


def told_apart(rows: DataFrame) -> DataFrame:
    """Measured rows with _nth, their number among equal rows, and a random number _u of their own. Equal rows are
    counted before the shuffle, and dealt out again in chunks."""
    same = ["doc_id", "_key", "_size", "_class", "_h"]
    counted = rows.groupBy(*same).agg(F.count("*").alias("_n"))
    starts = counted.select(*same, "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    starts = starts.filter(F.col("_n") <= CHUNK).union(starts.filter(F.col("_n") > CHUNK).repartition("_h", "_from"))
    out = starts.select(*same, F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + CHUNK, F.col("_n")) - 1)).alias("_nth"))
    return out.withColumn("_u", random(F.when(F.col("_nth") == 0, F.col("_h")).otherwise(F.xxhash64("_h", "_nth"))))


def by_size(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def ranked(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Adds the whole copies, the inclusion probability and the rank _q = random odds / inclusion odds."""
    rows = rows.join(strata, ["_key", "_class"])
    odds = F.col("_p") / F.nullif(1 - F.col("_p"), F.lit(0.0))
    q = F.when(F.col("_p") > 0, (F.col("_u") / (1 - F.col("_u"))) / odds)
    return rows.withColumn("_q", q).withColumn("_bin", F.floor(F.ln("_q") * BINS).cast("int"))


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, tilt: float = TILT, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix of docs as (compact rows, strata): the rows are stored without texts; strata has, by source
    and length class, the expected copies and the source's cut."""
    rows = materialize(told_apart(measured(docs.select("doc_id", "source", "text"), seed)), "sizes")
    classes = materialize(rows.groupBy("_key", "_class").agg(F.sum("_size").alias("_words")), "classes")
    sources = numbered(classes.groupBy("_key").agg(F.sum("_words").alias("_source_size")), "_key", name="sources")
    nth = F.col("_before") + F.col("_at")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int"))
    sources = materialize(sources.join(F.broadcast(part_starts(sources)), "_part").select("_key", "_source_size", cycle.alias("_weight")), "sources")
    weight, cap = F.col("_weight"), F.col("_source_size") * float(most)
    budget = float(sources.agg(F.sum("_source_size")).first()[0] or 0) * share
    sources = sources.select("_key", "_source_size", F.least(cap, F.lit(level(sources, weight, cap, budget)) * weight).alias("_target"))
    strata = classes.join(sources, "_key").withColumn("_grown", F.pow(F.lit(2.0), F.col("_class") * tilt) * F.col("_words"))
    strata = waterfill(strata, ["_key"], F.col("_grown"), F.col("_words") * most, F.col("_target"), "_share")
    copies = F.coalesce(F.try_divide(F.col("_share"), F.col("_words")), F.lit(0.0))
    strata = strata.withColumn("_copies", F.least(F.when(F.abs(copies - F.round(copies)) < 1e-9, F.round(copies)).otherwise(copies), F.lit(float(most))))
    strata = strata.withColumn("_whole", F.floor("_copies").cast("long")).withColumn("_p", F.col("_copies") - F.col("_whole"))
    strata = materialize(strata.withColumn("_left", F.col("_target") - F.sum(F.col("_whole") * F.col("_words")).over(Window.partitionBy("_key"))).select("_key", "_class", "_source_size", "_target", "_whole", "_p", "_left"), "strata")
    n = strata.count()

    drawn = ranked(rows, by_size(strata, n)).filter("_q is not null")
    bins = drawn.groupBy("_key", "_bin").agg(F.sum("_size").alias("_words"), F.first("_left").alias("_left"))
    below = F.sum("_words").over(Window.partitionBy("_key").orderBy("_bin"))
    edge = bins.withColumn("_sum", below).filter(F.col("_sum") >= F.col("_left")).groupBy("_key").agg(F.min(F.struct("_bin", (F.col("_sum") - F.col("_words")).alias("_before"))).alias("_e"))
    edge = materialize(edge.select("_key", F.col("_e._bin").alias("_edge"), F.col("_e._before").alias("_before")), "edges")
    near = drawn.join(by_size(edge, n), "_key").filter("_bin = _edge")
    upto = F.sum("_size").over(Window.partitionBy("_key").orderBy("_q", "_h", "_nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cuts = near.withColumn("_upto", F.col("_before") + upto).filter(F.col("_upto") - F.col("_size") / 2.0 <= F.col("_left"))
    cuts = cuts.groupBy("_key").agg(F.max(F.struct("_q", "_h", "_nth")).alias("_cut"))
    cuts = edge.select("_key", "_edge").join(cuts, "_key", "left")
    return rows, materialize(strata.drop("_left").join(cuts, "_key", "left"), "mix")


def decided(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Adds _taken_copies to measured rows."""
    rows = ranked(rows, by_size(strata, strata.count()))
    drawn = F.col("_edge").isNull() | (F.col("_bin") < F.col("_edge")) | ((F.col("_bin") == F.col("_edge")) & (F.struct("_q", "_h", "_nth") <= F.col("_cut")))
    return rows.withColumn("_taken_copies", F.col("_whole") + F.when(F.col("_q").isNotNull() & F.coalesce(drawn, F.lit(False)), 1).otherwise(0))


def allocation(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document.

    A null text has size 0, a null source is a source of its own (the last); rows equal in doc_id,
    source and text are numbered and drawn one by one; null ids are like any other; a very long text counts
    with all its words and can leave its source a half of its size off the target; a corpus without words
    takes nothing; other columns of docs are ignored; an empty table gives no rows.
    """
    rows, strata = plan(docs, seed=seed, **how)
    out = decided(rows, strata)
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_taken_copies") * F.col("_size")).alias("taken"), F.col("_taken_copies").alias("copies"))


def mix(docs: DataFrame, seed: int = 7, **how) -> DataFrame:
    """The mixed documents with the columns of docs, a row for each copy that the mix takes (see `allocation`).
    Of rows equal in doc_id, source and text as many are drawn as the plan says; which of them is open, should
    their other columns differ."""
    kept = measured(docs.select(whole_row(docs).alias("_row"), "doc_id", "source", "text"), seed)
    rows, strata = plan(docs, seed=seed, **how)
    repeats = decided(rows, strata).groupBy("_h").agg(F.count("*").alias("_n"), F.sum(F.col("_taken_copies") - F.col("_whole")).alias("_draws")).filter("_n > 1")
    repeats = materialize(repeats, "repeats")
    kept = kept.join(by_size(repeats, repeats.count()), "_h", "left").withColumn("_nth", F.lit(0).cast("long"))
    kept = decided(kept.withColumn("_u", random(F.col("_h"))), strata)
    drawn = F.when(F.col("_draws") == 0, F.col("_whole")).when(F.col("_draws") == F.col("_n"), F.col("_whole") + 1).otherwise(F.col("_taken_copies"))
    split = F.coalesce((F.col("_draws") > 0) & (F.col("_draws") < F.col("_n")), F.lit(False))
    out = kept.filter(~split).select("_row", F.when(F.col("_n").isNull(), F.col("_taken_copies")).otherwise(drawn).alias("_taken_copies"))
    # some of equal rows: stored with a number, counted by cells, so that no task has a whole group
    some = materialize(kept.filter(split).select("_row", "_h", "_whole", "_draws", F.monotonically_increasing_id().alias("_id")), "some")
    cell = F.pmod(F.xxhash64("_id"), F.lit(256))
    some = some.withColumn("_cell", cell)
    before = some.groupBy("_h", "_cell").agg(F.count("*").alias("_c"))
    before = before.withColumn("_c", F.sum("_c").over(Window.partitionBy("_h").orderBy("_cell")) - F.col("_c"))
    some = some.withColumn("_nth", F.row_number().over(Window.partitionBy("_h", "_cell").orderBy("_id"))).join(before, ["_h", "_cell"])
    some = some.select("_row", (F.col("_whole") + F.when(F.col("_nth") + F.col("_c") <= F.col("_draws"), 1).otherwise(0)).alias("_taken_copies"))
    out = out.union(some).filter("_taken_copies > 0")
    return out.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_taken_copies"))).alias("_copy")).select("_row.*")
