"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Every row gets a global row number 0..N-1 (its rank by the hash of its id, then id, then text). A keyed Feistel network over
pairs (left, right) with left < a and right < b, a * b >= N, permutes 0..a*b-1; a value of N or more is sent through the
network again until it falls below N (cycle walking), which leaves a permutation of 0..N-1. The permuted number p gives
``shard = p mod shards`` and ``slot = p div shards``, so shard sizes differ by one row at most and slots have no gaps. The
network runs backwards too: ``row_number_at`` computes which row lies at a shard and slot without reading any table.

All of it is column expressions. The walk has an exact end: it can only pass the a*b-N values outside, so its loop is
that long and is entered by the few rows outside only (fewer than 1 in sqrt(N)).

Defined cases: a null text has no bytes (size 16, checksum 0); a null id is an id of its own; repeated rows are all
kept and differ in slot only; an empty table gives an empty table; columns beside id and text are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARDS = 40
ROW_BYTES = 16
ROUNDS = 6
SEED = 42
PIECES = 4096


def global_row_numbers(df: DataFrame, id_col: str, *ties: str) -> DataFrame:
    """Add ``row_number`` (from 0): the rank of each row by the hash of its id, then id, then ``ties``.

    The hash cuts the table into 4096 even pieces that are sorted each on its own; the sizes of the pieces before, one
    row per piece, give the rest of the number. The sizes are counted from the id column alone.
    """
    piece = F.pmod(F.xxhash64(id_col), F.lit(PIECES))
    before = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = df.groupBy(piece.alias("_piece")).agg(F.count(F.lit(1)).alias("_n")).select(
        "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_piece").orderBy(F.xxhash64(id_col), id_col, *ties)
    return (
        df.withColumn("_piece", piece).withColumn("_place", F.row_number().over(inside))
        .join(F.broadcast(sizes), "_piece")  # 4096 rows at most
        .withColumn("row_number", F.col("_place") - 1 + F.col("_before")).drop("_piece", "_place", "_before")
    )


def _sides(rows: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(rows, 1) - 1) + 1)
    return a, max(1, -(-rows // a))



def _network(value: Column, rows: int, seed: int, back: bool = False) -> Column:
    """One pass of the network: even rounds move the left half by the right one, odd rounds the other way round."""
    a, b = _sides(rows)
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if back else 1

    def step(state: Column, k: Column) -> Column:
        left, right = state["l"], state["r"]
        moved = lambda half, other, side: F.pmod(
            half + sign * F.pmod(F.xxhash64(other, F.lit(seed), k), F.lit(side)), F.lit(side))
        even = k % 2 == 0
        return F.struct(
            F.when(even, moved(left, right, a)).otherwise(left).alias("l"),
            F.when(even, right).otherwise(moved(right, left, b)).alias("r"))

    start = F.struct(F.floor(value / F.lit(b)).cast("long").alias("l"), F.pmod(value, F.lit(b)).cast("long").alias("r"))
    if rows > 1 << 52:
        raise ValueError("row numbers up to 2**52 are supported")
    return F.aggregate(rounds, start, step, lambda s: s["l"] * F.lit(b) + s["r"])


def permuted(value: Column, rows: int, seed: int = SEED, back: bool = False) -> Column:
    """The place of row number ``value`` in a shuffle of ``rows`` rows; ``back`` gives the row number of a place."""
    a, b = _sides(rows)
    outside = a * b - rows
    first = _network(value.cast("long"), rows, seed, back)
    if outside <= 0:
        return first
    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(outside)), first,
        lambda x, _: F.when(x < rows, x).otherwise(_network(x, rows, seed, back)))
    return F.when(first < rows, first).otherwise(walk)


def row_number_at(shard: Column, slot: Column, rows: int, shards: int = SHARDS, seed: int = SEED) -> Column:
    """Which global row number lies at ``slot`` of ``shard``."""
    return permuted(slot.cast("long") * shards + shard, rows, seed, back=True)


def sharded(
    df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED,
) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``law``, ``shard``, ``slot``, ``grown_shard``, ``row_number``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = df.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    rows = df.count()
    place = permuted(F.col("row_number"), rows, seed)
    return global_row_numbers(narrow, "doc_id", "text_crc32", "size").withColumn("_p", place).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_p") % shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.col("row_number").cast("long").alias("row_number"))
