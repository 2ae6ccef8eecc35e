"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.session import written


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """``node``, ``label`` for every node of ``edges`` (columns ``a``, ``b``): the smallest node it is connected to.

    Large-star hangs a node's larger neighbours on the smallest node it knows, small-star its smaller ones; the steps
    repeat until no edge changes (a number of rounds that grows with the logarithm of the longest path squared at worst). The least neighbour is a
    partial aggregate and the step back is a join on a node, so a node with a third of all edges is split by the skew
    join. Every round is written to the shared folder. An empty edge table gives an empty result.
    """
    current = written(spark, edges.where("a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(current)
    while True:
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        large = written(spark, large, "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")),
        )).alias("e")).select("e.*").where("a <> b").distinct()
        current = written(spark, small, "edges")
        now = _mark(current)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("label")).union(roots)


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal only for the same edges."""
    hashed = F.xxhash64("a", "b").cast("decimal(38,0)")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(hashed)).first())
