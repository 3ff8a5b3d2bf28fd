"""Connected components by joins: alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlab.llm.common import materialise, salted_join


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("low"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: bigint); root is the smallest node.

    Every round ties each node's neighbours to the smallest one, so a component becomes a
    star in a number of rounds that grows with the logarithm of its size. Each round is
    written, so lost executors cost a stage and not the run. Loops and repeated edges
    do no harm; null ends are left out.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialise(now, "edges"), None
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = _lowest(both).select("a", F.least("a", "low").alias("low"))
        large = salted_join(both.filter("b > a"), low, ["a"], F.col("b"), salts=8).select(F.col("b").alias("a"), F.col("low").alias("b"))
        # A node without larger neighbours keeps its edge to its lowest one.
        large = materialise(large.distinct(), "large-star")
        low = _lowest(large)
        small = salted_join(large, low, ["a"], F.col("b"), salts=8)
        small = small.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        now = materialise(small.distinct(), "small-star")
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if state == seen:
            break
        seen = state
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
