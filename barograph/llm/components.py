"""Connected components of an edge table, for graphs of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of edges (a, b: longs); component is the smallest node reachable.

    Alternating large-star and small-star steps: every step hooks a node's neighbours to the smallest
    one, so that each component ends as a star around its smallest node after a few rounds. Minimums
    are combined before the shuffle and hot nodes are left to the skew join. Each round is stored in
    the shared folder, and the one before removed. An empty table gives no rows; loops and repeated edges change nothing.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    seen = None
    for _ in range(rounds):
        mark = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.coalesce(F.sum(F.xxhash64("v", "u") % 1000003), F.lit(0))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, both["u"] == least["k"]).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large, large_path = stored(large, "edges")
        remove(spark, path)
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        small = large.join(least, large["u"] == least["k"]).select(F.col("v"), F.col("m"), F.col("k"))
        now, path = stored(small.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").union(least.select("k", "m")).distinct(), "edges")
        remove(spark, large_path)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
