"""Connected components of a link table, by alternating large and small stars.

Each round replaces links by links to the least neighbour; a hub's links are reduced by
partial aggregation before they meet, and the rows of hubs are spread: they stay where
they are and meet a broadcast of bounded size. Rounds grow with the logarithm of a
component's diameter. Each round ends in a table of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, spread_join


def components(links: DataFrame, work: Scratch) -> DataFrame:
    """(node, root) of every node that has a link; ``links`` has columns a and b. Root: the least node of the component. Nulls and loops link nothing."""
    steps = Scratch(links.sparkSession)

    def signature(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree"))

    now = work.stored(links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    sign = signature(now)
    while sign[0]:
        both = now.union(now.select(F.col("b"), F.col("a")))
        large = spread_join(both, least(both), ["a"], "degree", 2 * sign[0]).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        large = steps.stored(large, "large")
        small = spread_join(large, least(large), ["a"], "degree", 2 * sign[0]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        before, now = now, work.stored(small, "links")
        old, sign = sign, signature(now)
        steps.drop()
        work.remove(before)
        if sign == old:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b"), F.col("b")).distinct())
