"""Contrastive training of a linear projection: pairs of one class are drawn together, pairs of two classes pushed apart.

Both vectors of a pair go through the same projection W (a Siamese pair). With d the length of W (a - b), a pair of one class costs d * d and one
of two classes max(0, margin - d) squared. Pairs come from ``pairs.pair_table`` and are stored with both vectors once. In a
round every task adds up cost and gradient of its pairs, batch by batch, and hands on one small matrix; Spark adds those
up by entry, so the driver sees W's own size whatever the number of pairs. The step is halved until the mean cost
falls, so the cost never rises from one round to the next.

Defined cases: pairs with a null vector, a null or NaN component, or another length than W are left out and not counted; without any pair W stays
as it is; two equal vectors of two classes cost the margin and have no direction to be pushed to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.session import written

MARGIN = 1.0
STEP = 0.5
TRIES = 12


@dataclass
class Round:
    number: int
    loss: float
    step: float
    pairs: int


def vector_pairs(spark: SparkSession, pairs: DataFrame, vectors: DataFrame, row: str = "row_idx", vector: str = "embedding") -> DataFrame:
    """``a``, ``b``, ``same`` for every row of a pair table (``row_1``, ``row_2``, ``same``); stored, since every round reads it. A row's vector is
    fetched by its key; each row is in as many pairs as it has partners, so there is no hot key."""
    first = vectors.select(F.col(row).alias("row_1"), F.col(vector).cast("array<double>").alias("a"))
    second = vectors.select(F.col(row).alias("row_2"), F.col(vector).cast("array<double>").alias("b"))
    return written(spark, pairs.join(first, "row_1").join(second, "row_2").select("a", "b", "same"), "vector-pairs")


def first_projection(size_in: int, size_out: int, seed: int = 42) -> np.ndarray:
    """Seeded directions of length one."""
    start = np.random.default_rng(seed).normal(size=(size_out, size_in))
    return start / np.sqrt((start * start).sum(axis=1, keepdims=True))


def _differences(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """a - b of the whole pairs of a batch, and whether they are of one class."""
    a, b, same = (batch.column(k) for k in range(3))
    fits = pc.and_(pc.equal(pc.list_value_length(a), width), pc.equal(pc.list_value_length(b), width))
    batch = batch.filter(pc.fill_null(pc.and_(fits, pc.is_valid(same)), False))
    rows = [batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(-1, width) for k in (0, 1)]
    delta = rows[0] - rows[1]
    whole = np.isfinite(delta).all(axis=1)
    return delta[whole], batch.column(2).to_numpy(zero_copy_only=False)[whole] == 1


def loss_and_gradient(w: np.ndarray, delta: np.ndarray, same: np.ndarray, margin: float = MARGIN) -> tuple[float, np.ndarray]:
    """Sums over the pairs."""
    z = delta @ w.T
    d = np.sqrt((z * z).sum(axis=1))
    short = np.maximum(margin - d, 0.0)
    loss = np.where(same, d * d, short * short).sum()
    scale = np.where(same, 2.0, -2.0 * short / np.maximum(d, 1e-12)) * (same | (d > 1e-12))
    return float(loss), (z * scale[:, None]).T @ delta


def totals(pairs: DataFrame, w: np.ndarray, margin: float = MARGIN) -> tuple[float, np.ndarray, int]:
    """Mean cost, mean gradient and number of all pairs under one projection."""
    size = w.size

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + 2)
        for batch in batches:
            delta, same = _differences(batch, w.shape[1])
            loss, gradient = loss_and_gradient(w, delta, same, margin)
            sums += np.concatenate([gradient.ravel(), [loss, len(delta)]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size + 2)), pa.array(sums)], ["place", "x"])

    added = np.zeros(size + 2)
    for row in pairs.select("a", "b", "same").mapInArrow(task, "place bigint, x double").groupBy("place").agg(F.sum("x")).collect():
        added[row[0]] = row[1]  # as many rows as W has entries
    n = int(added[-1])
    return (float(added[-2] / n), added[:size].reshape(w.shape) / n, n) if n else (0.0, np.zeros(w.shape), 0)


def train(pairs: DataFrame, w: np.ndarray, rounds: int = 10, margin: float = MARGIN, step: float = STEP) -> tuple[np.ndarray, list[Round]]:
    """The projection after some rounds, and the cost before the first and after each of them.

    A round tries its step, and halves it until the mean cost is lower; a round that finds none after ``TRIES`` halvings ends the training.
    The next round starts from twice the step that worked.
    """
    loss, gradient, n = totals(pairs, w, margin)
    history = [Round(0, loss, 0.0, n)]
    for number in range(1, rounds + 1):
        for _ in range(TRIES):
            tried = w - step * gradient
            found = totals(pairs, tried, margin)
            if found[0] < loss:
                break
            step /= 2
        else:
            break
        w, (loss, gradient, n) = tried, found
        history.append(Round(number, loss, step, n))
        step *= 2
    return w, history


def projected(vector: Column, w: np.ndarray) -> Column:
    """W times the vector, as an array; null for a null vector or one of another length. One matrix product per Arrow batch."""
    width = w.shape[1]

    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            good = pc.fill_null(pc.equal(pc.list_value_length(batch), width), False).to_numpy(zero_copy_only=False)
            rows = batch.filter(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)
            out = rows @ w.T
            sizes = np.where(good, len(w), 0)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()), mask=pa.array(~good))

    return F.arrow_udf(apply, T.ArrayType(T.DoubleType()))(vector)
