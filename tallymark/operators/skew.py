"""Joins and ranks that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_SHARE = 256
_BUCKET_DIGITS = 4


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> DataFrame:
    """Keys that hold more than 1/``share`` of all rows, so fewer than ``share`` of them, and their ``_part`` of all rows."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.agg(F.sum("_n").alias("_total"))
    hot = counts.join(F.broadcast(total)).where(F.col("_n") * share > F.col("_total"))
    return hot.select(key, (F.col("_n") / F.col("_total")).alias("_part"))


def salted_lookup(
    left: DataFrame, right: DataFrame, key: str, spread_by: str, how: str, share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``left`` to the one row per key of ``right``.

    Rows of a hot key are dealt out by their ``spread_by`` value, and the one matching row is copied to each salt. A key has as many
    salts as shuffle partitions times its part of all rows, so each of its tasks has about as many rows as any other. All other
    keys join once. The hot list has fewer than ``share`` rows, so it is safe to broadcast.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salts = (F.ceil(F.col("_part") * tasks) + 1).cast("int")
    marked = F.broadcast(hot_keys(left, key, share).select(key, salts.alias("_salts")))
    n = F.coalesce(F.col("_salts"), F.lit(1))
    dealt = left.join(marked, key, "left").withColumn(
        "_salt", F.pmod(F.xxhash64(spread_by), n).cast("int")).drop("_salts")
    copied = right.join(marked, key, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_salts")
    return dealt.join(copied, [key, "_salt"], how).drop("_salt")


def join_same(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Join on equal columns, a null being equal to a null; the columns appear once."""
    renamed = right.withColumnsRenamed({c: f"_same_{c}" for c in columns})
    condition = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_same_{c}")) for c in columns])
    return left.join(renamed, condition, how).drop(*[f"_same_{c}" for c in columns])


def _bucketed(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_bucket", F.substring(order, 1, _BUCKET_DIGITS))


def bucket_counts(df: DataFrame, group: str, order: str) -> DataFrame:
    """Rows per group and per leading hex digits of the order hash, with the number of rows before each bucket."""
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = _bucketed(df, order).groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    return counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def hash_rank(df: DataFrame, group: str, order: str, tie: str, buckets: DataFrame) -> DataFrame:
    """Add ``rank``: the exact place (from 1) of each row in its group by a hex hash column, then by ``tie``.

    The first four hex digits cut every group into 65536 even pieces. Only a piece is sorted in one task; the sizes of
    the pieces before it (``buckets``, from ``bucket_counts``) give the rest of the place, so a group with half of all
    rows is ranked in parallel. Further columns of ``buckets`` come along.
    """
    inside = Window.partitionBy(group, "_bucket").orderBy(order, tie)
    return (
        _bucketed(df, order).withColumn("_place", F.row_number().over(inside))
        .transform(lambda d: join_same(d, buckets.drop("_n"), [group, "_bucket"]))
        .withColumn("rank", F.col("_place") + F.col("_before"))
        .drop("_bucket", "_place", "_before")
    )


def text_key(text: Column) -> Column:
    """A short stand-in for a long text in shuffles and joins; never null, so a row without a text is not lost there."""
    return F.coalesce(F.sha2(text, 256), F.lit(""))
