"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    Alternating large-star and small-star steps: every step hangs nodes on the smallest
    neighbour by a minimum per node and a join, so no neighbour list is ever gathered, and
    the number of steps grows with the logarithm of the longest path.  Every step's
    links are stored, which cuts the lineage.  The steps end when all links are stars: every node hangs on one
    other, and none that others hang on hangs itself.
    """
    def distinct(e: DataFrame) -> DataFrame:
        return e.where("u != v").distinct()

    def stars(e: DataFrame) -> bool:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        both = ends.groupBy("x").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
        return both.agg(F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") > 0)))).first()[0] == 0

    links = stored(distinct(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))), "links")
    while not stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = distinct(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = stored(large, "links")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = stored(distinct(small.unionByName(low.select("u", F.col("m").alias("v")))), "links")
    roots = links.select(F.col("v").alias("node")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        roots.select("node", F.col("node").alias("root")))
