"""Connected components of a distributed graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import stored

#: Links are few beside the rows that they come from: their tables take one in so many of the session's partitions.
SHARE = 4


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b: longs), label being the least node of its component.

    Large star: every node's greater neighbours move to its least neighbour.  Small star: its smaller ones
    do.  Both repeat until nothing changes; the rounds grow as the square of the logarithm of the nodes at
    worst.  No node's neighbours are ever gathered: the least is a partial aggregate, and the join that hands
    it out takes both sides from a shuffle, so the neighbours of a hub can be split among tasks.
    """

    def handed(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
        least = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), "stars-least", SHARE)
        return pairs.join(least, "u"), least

    def is_done(pairs: DataFrame) -> bool:
        """Whether every node has one label, and no label has one itself."""
        ends = pairs.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root")).union(pairs.select("v", F.lit(0), F.lit(1)))
        seen = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        return seen.where("leaf > 1 or (leaf = 1 and root = 1)").isEmpty()

    table = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars", SHARE)
    while not is_done(table):
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = handed(both)[0].where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        down, least = handed(stored(large, "stars-large", SHARE))
        small = down.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        table = stored(small.distinct(), "stars", SHARE)
    return table.select(F.col("u").alias("node"), F.col("v").alias("label")).union(table.select("v", "v").distinct())
