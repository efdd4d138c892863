"""Connected components by alternating stars; links stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b) except the roots; root is the smallest node reached.

    Each round hangs larger neighbours on the smallest neighbour (large star) and then smaller ones
    on it (small star), until every node hangs on one that hangs on none; the number of rounds grows
    with the logarithm of the longest path. Each round is written to the shared folder, which also
    cuts the lineage. Links of a node to itself and repeated links do not matter; without links there
    are no rows.
    """
    # Links are two numbers each: a few files a core hold them, however many partitions a shuffle has.
    files = 4 * links.sparkSession.sparkContext.defaultParallelism
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
                 .distinct().coalesce(files), "links")
    while not _settled(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.withColumnRenamed("m", "v")).distinct())
        now = stored(small.coalesce(files), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _settled(links: DataFrame) -> bool:
    """True if every node of ``links`` (u, v), u > v, without repeats, has one v that is no u: all are stars."""
    ends = (links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    open_nodes = (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
                  .where("up + down > 1"))
    return open_nodes.agg(F.count("*")).first()[0] == 0
