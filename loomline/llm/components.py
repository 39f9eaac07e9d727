"""Connected components of a graph whose edges are a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, skew_join, written

HUB = 1000


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each node's component, for all nodes of `edges` (a, b).

    Alternating star contractions: each node's larger neighbours, then its smaller ones, are tied
    to the least of its neighbourhood, until no edge changes. The number of rounds grows with the
    logarithm of the largest component; every round is two aggregations and two joins on the
    node. Its result is written and that of the round before deleted. If a node has more than `HUB`
    neighbours and a fiftieth of all edges, the joins are written so that its edges can go to several tasks.
    """
    spark = edges.sparkSession
    edges, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        ends = both.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
        now = ends.agg(F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.max("n").alias("top")).head()
        if now == state or not now.n:
            break
        state = now
        meet = skew_join if now.top > max(HUB, now.n / 50) else DataFrame.join
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = meet(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = meet(large, least, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = path
        edges, path = written(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        discard(spark, old)
    nodes = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
    roots = checkpointed(nodes.unionByName(edges.select(F.col("b").alias("node")).distinct().withColumn("root", F.col("node"))))
    discard(spark, path)
    return roots
