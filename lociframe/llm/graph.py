"""Connected components by alternating stars; no task holds more than the edges Spark deals to it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.config import pin


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the root is the least node of its component.

    Each round hangs the larger neighbours of a node, then its smaller ones, onto the least neighbour; a path of n nodes takes about log n rounds.
    """
    now = pin(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == mark:
            break
        mark = new
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("lo")).select(F.col("n").alias("k"), F.least("n", "lo").alias("lo"))
        large = both.where("m > n").join(least, F.col("n") == F.col("k")).select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("lo")).withColumnRenamed("u", "k")
        small = large.join(low, F.col("u") == F.col("k"))
        small = small.select(F.col("u"), F.col("lo").alias("v")).unionByName(small.select(F.col("v").alias("u"), F.col("lo").alias("v")))
        now = pin(small.where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
