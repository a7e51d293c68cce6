"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b): root is the least node that it is connected with.

    Self loops, repeated edges and either order are allowed; nulls are dropped; no edges give no rows.
    Each round is written to the shared folder, so a lost executor repeats one round only, and nothing is
    collected. The number of rounds grows with the logarithm of the longest path.
    """
    clean = edges.filter("a is not null and b is not null")
    now = clean.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = common.written(now, "cc")
    before = None
    while True:
        # large star: neighbours above a node go to its least neighbour
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.union(least.filter("m < u").toDF("a", "b")).filter("a <> b").distinct()
        # small star: neighbours below a node, and the node, go to the least of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b"))
        last, now = now, common.written(small.distinct(), "cc")
        common.discard(last)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    roots = now.toDF("node", "root")
    return roots.union(roots.select("root", "root").distinct())
