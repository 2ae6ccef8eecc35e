"""The index for a large catalogue against comparing all with all."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.operators import nearest


def cosine(a, b):
    length = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / length if length else 0.0


def plain(rows, asked, others_only):
    out = {}
    for i, v in asked:
        scored = [(-round(cosine(v, w), 12), j) for j, w in rows if not (others_only and i == j)]
        out[i] = min(scored)[1] if scored else None
    return out


def vectors(n, seed, width=5, centres=6):
    draw = random.Random(seed)
    middle = [[draw.gauss(0, 2) for _ in range(width)] for _ in range(centres)]
    return [(i, [x + draw.gauss(0, 1) for x in middle[i % centres]]) for i in range(n)]


@pytest.mark.parametrize("block,probes", [(1024, 2), (7, 1)])
@pytest.mark.parametrize("others_only", [True, False])
def test_exact_search(spark, monkeypatch, block, probes, others_only):
    monkeypatch.setattr(nearest, "BLOCK", block)
    rows = vectors(150, 3)
    rows += [(500 + k, rows[0][1]) for k in range(40)] + [(700, [0.0] * 5)]  # a hot vector, and one without a direction
    asked = rows[::6] + [(700, [0.0] * 5), (900, [1.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").withColumn("list", F.lit(1)).withColumn("score", F.lit(1))
    index = nearest.build_index(spark, df, "id", "v", lists=8, rounds=2)
    got = nearest.nearest(spark, index, spark.createDataFrame(asked, "id long, v array<double>"), "id", "v", probes, True, others_only)
    found = {r["name"]: (r["found"], r["score"]) for r in got.collect()}
    want, by_id = plain(rows, asked, others_only), dict(rows)
    assert {k: f for k, (f, _) in found.items()} == want
    assert all(s == pytest.approx(cosine(dict(asked)[k], by_id[f]), abs=1e-9) for k, (f, s) in found.items())


def test_bounded_probes_reach_nine_in_ten(spark):
    rows = vectors(3000, 5, width=16, centres=40)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = nearest.build_index(spark, df, "id", "v", sample=1000)
    assert len(index.centroids) == 54 and index.blocks.agg(F.sum(F.size("names"))).first()[0] == 3000
    asked = rows[::30]
    got = nearest.nearest(spark, index, df.where("id % 30 = 0"), "id", "v", probes=16, others_only=True)
    want = plain(rows, asked, True)
    found = {r["name"]: r["found"] for r in got.collect()}
    assert sum(found[k] == want[k] for k in want) >= 0.9 * len(want)


def test_odd_vectors_and_empty_tables(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", [1.0]), ("e", [math.nan, 1.0]), ("f", [None, 1.0]), ("a2", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "id string, v array<float>")
    index = nearest.build_index(spark, df, "id", "v")
    got = {r["name"]: r["found"] for r in nearest.nearest(spark, index, df, "id", "v").collect()}
    assert got == {"a": "a", "b": "b", "a2": "a"}
    none = nearest.build_index(spark, df.where("false"), "id", "v")
    assert nearest.nearest(spark, none, df, "id", "v").count() == 0
    assert nearest.nearest(spark, index, df.where("false"), "id", "v", exact=True).count() == 0
