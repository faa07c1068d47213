"""Connected components of a table of edges between 64-bit nodes, in rounds whose number grows with the logarithm of the
longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import removed, written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of each node of ``edges`` (a, b bigint): the smallest node that it is connected with.

    A round first links all larger neighbours of a node, and then all of its smaller ones, to the smallest of them;
    edges always lead to a smaller node, and stars are left in the end. Each round is written; only the number of edges
    and a sum over them reach the driver. Loops and repeated edges are allowed.
    """
    rows = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    now, seen = written(rows.distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen, before = state, now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("a", "low"))
        larger = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = written(larger.distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        smaller = large.join(low, "a").where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        now = written(smaller.unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "small-star")
        removed(before)
        removed(large)
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return ends.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def chain_ends(links: DataFrame, start: str, to: str) -> DataFrame:
    """(``start``, end, odd) for each row of ``links``, which leads from a node to one other node, without circles: the
    node without a link that it leads to in the end, and whether the number of links up to there is odd.

    Links are made twice as long in each round, so the number of rounds grows with the logarithm of the longest chain.
    Each round is written.
    """
    now = written(links.select(F.col(start).alias("node"), F.col(to).alias("end"), F.lit(True).alias("odd")), "links")
    while True:
        ahead = now.select(F.col("node").alias("end"), F.col("end").alias("next"), F.col("odd").alias("more"))
        end, odd = F.coalesce("next", "end").alias("end"), (F.col("odd") != F.coalesce("more", F.lit(False))).alias("odd")
        longer = written(now.join(ahead, "end", "left").select("node", end, odd, F.col("next").isNotNull().alias("on")), "links")
        removed(now)
        now = longer
        if longer.where("on").isEmpty():
            return now.select(F.col("node").alias(start), "end", "odd")
