"""Contrastive training: gradient by differences, falling cost, and the head it is for."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallymark.operators import contrastive

draw = np.random.default_rng(6)


def plain_loss(w, pairs, margin=1.0):
    total = 0.0
    for a, b, same in pairs:
        z = [sum(w[i][j] * (a[j] - b[j]) for j in range(len(a))) for i in range(len(w))]
        d = math.sqrt(sum(x * x for x in z))
        total += d * d if same else max(0.0, margin - d) ** 2
    return total / len(pairs)


def some_pairs(n=60, width=4):
    return [(draw.normal(size=width).tolist(), draw.normal(size=width).tolist(), k % 2) for k in range(n)]


def frame(spark, pairs):
    return spark.createDataFrame([(a, b, s) for a, b, s in pairs], "a array<double>, b array<double>, same int").withColumn("place", F.lit(1))


def test_gradient_against_differences(spark):
    pairs, w = some_pairs(), contrastive.first_projection(4, 3) * 0.4
    loss, gradient, n = contrastive.totals(frame(spark, pairs), w)
    assert n == 60 and loss == pytest.approx(plain_loss(w, pairs), abs=1e-12)
    for i in range(3):
        for j in range(4):
            up, down = w.copy(), w.copy()
            up[i, j] += 1e-6
            down[i, j] -= 1e-6
            assert gradient[i, j] == pytest.approx((plain_loss(up, pairs) - plain_loss(down, pairs)) / 2e-6, abs=1e-5)


def test_cost_falls_every_round(spark):
    centres = draw.normal(size=(3, 6)) * 2
    rows = [(centres[k % 3] + draw.normal(size=6), k % 3) for k in range(90)]
    pairs = [(rows[i][0].tolist(), rows[(i + s) % 90][0].tolist(), int(rows[i][1] == rows[(i + s) % 90][1])) for i in range(90) for s in (1, 3)]
    w, history = contrastive.train(frame(spark, pairs), contrastive.first_projection(6, 2), rounds=5)
    losses = [r.loss for r in history]
    assert len(losses) == 6 and all(b < a for a, b in zip(losses, losses[1:]))
    assert losses[-1] == pytest.approx(plain_loss(w, pairs), abs=1e-9)
    assert [r.pairs for r in history] == [180] * 6


def test_odd_pairs_are_left_out(spark):
    pairs = some_pairs(10)
    odd = [(None, [1.0] * 4, 1), ([1.0] * 4, [1.0, None, 1.0, 1.0], 1), ([math.nan] * 4, [1.0] * 4, 0), ([1.0] * 3, [1.0] * 4, 1), ([1.0] * 4, [2.0] * 4, None), ([], [], 1)]
    w = contrastive.first_projection(4, 2)
    loss, _, n = contrastive.totals(frame(spark, pairs + odd), w)
    assert n == 10 and loss == pytest.approx(plain_loss(w, pairs), abs=1e-12)
    equal = [([1.0] * 4, [1.0] * 4, 0)]
    loss, gradient, n = contrastive.totals(frame(spark, equal), w)
    assert (loss, n) == (1.0, 1) and not gradient.any()
    same, history = contrastive.train(frame(spark, []), w, rounds=2)
    assert (same == w).all() and len(history) == 1 and history[0].pairs == 0


def test_projection_of_a_column(spark):
    w = contrastive.first_projection(3, 2)
    rows = [(1, [1.0, 2.0, 3.0]), (2, None), (3, [0.5, 0.0, -1.0]), (4, [1.0]), (5, [])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r["id"]: r["z"] for r in df.select("id", contrastive.projected(F.col("v"), w).alias("z")).collect()}
    assert got[2] is None and got[4] is None and got[5] is None
    for k in (1, 3):
        assert got[k] == pytest.approx([sum(a * b for a, b in zip(line, dict(rows)[k])) for line in w], abs=1e-6)
    assert df.where("false").select(contrastive.projected(F.col("v"), w)).count() == 0
