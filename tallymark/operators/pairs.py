"""Pairs of training texts, of the same class and of different classes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallymark.operators.prepare import seeded_hash
from tallymark.operators.skew import bucket_counts, hash_rank, join_same, salted_lookup


def pair_table(df: DataFrame, iterations: int = 1, seed: int = 42, key: str = "text_key", tie: str = "row_idx",
               ) -> DataFrame:
    """For each row ``iterations`` partners of its class (``same`` 1) and as many of other classes (``same`` 0).

    Rows stand in one long line: by class, then by a seeded hash. A row's same-class partners are the next ones of its
    class, its other partners the ones at its own place in the line without its class; both go round at the end. So
    every partner is found by an equal join on a place number that occurs once, and no group is paired up with itself.
    A class of one row pairs with itself; without a second class there are no ``same`` 0 pairs.
    """
    hashed = df.select(key, tie, "label").withColumn("_hash", seeded_hash(key, seed))
    buckets = bucket_counts(hashed, "label", "_hash")
    everything = Window.partitionBy()
    before = Window.orderBy("label").rowsBetween(Window.unboundedPreceding, -1)
    classes = buckets.groupBy("label").agg(F.sum("_n").alias("size")).select(
        "label", "size", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"),
        F.sum("size").over(everything).alias("total"),
    )
    line = hash_rank(hashed, "label", "_hash", tie, join_same(buckets, classes, ["label"])).select(
        key, tie, "label", "size", "start", "total", (F.col("rank") - 1).alias("place")
    )
    turn = F.explode(F.sequence(F.lit(1), F.lit(iterations)))
    asked = line.withColumn("iteration", turn)
    others = F.col("total") - F.col("size")
    same = F.col("start") + F.pmod(F.col("place") + F.col("iteration"), F.col("size"))
    other = F.when(others > 0, F.pmod(F.col("place") + F.col("iteration"), F.nullif(others, F.lit(0))))
    other = F.when(other < F.col("start"), other).otherwise(other + F.col("size"))
    wanted = asked.select(
        F.col(tie).alias("row_1"), "iteration",
        F.explode(F.array(
            F.struct(F.lit(1).alias("same"), same.alias("at")), F.struct(F.lit(0).alias("same"), other.alias("at")),
        )).alias("_w"),
    ).select("row_1", "iteration", "_w.same", "_w.at")
    partners = line.select((F.col("start") + F.col("place")).alias("at"), F.col(tie).alias("row_2"))
    # A large class asks for the few places of a small one again and again, so places are looked up with salts.
    return salted_lookup(wanted, partners, "at", "row_1", "inner").select("row_1", "row_2", "same", "iteration")
