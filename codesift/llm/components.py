"""Connected components by alternating large-star and small-star steps.

Each step is a minimum per node and a join; nothing is gathered per node or component.
Edges are written to the shared folder after each round, so a lost executor repeats at
most one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codesift.llm.store import written


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """(a, b) links between different longs to (node, root): the smallest node each one reaches."""
    now = written(_small_star(edges), "stars")
    mark = None
    while True:
        found = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (found["n"], found["s"]) == mark:
            break
        mark = (found["n"], found["s"])
        now = written(_small_star(_large_star(now)), "stars")
    out = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return out.union(out.select("root", "root")).distinct()
