"""Closed-form classifiers against a plain reading of their formulas, and their defined cases."""

import math
import random
import re
from collections import Counter, defaultdict
from hashlib import md5

import pytest
from pyspark.sql import functions as F

from tallymark.operators import bayes

POOL = ["preis", "Qualität", "frist", "und", "der", "x1", "x2", "Termin"]


def feature(word, digits=4):
    return md5(word.encode()).hexdigest()[:digits]


def plain_scores(train, texts, digits=4, alpha=1.0):
    rows, counts = Counter(), defaultdict(Counter)
    for text, label in train:
        if label is not None:
            rows[label] += 1
            counts[label].update(feature(w, digits) for w in re.findall("[a-z0-9]+", (text or "").lower()))
    names = sorted(rows)
    return names, [[
        math.log(rows[c] / rows.total()) + sum(
            math.log((counts[c][feature(w, digits)] + alpha) / (counts[c].total() + alpha * 16 ** digits))
            for w in re.findall("[a-z0-9]+", (t or "").lower())) for c in names] for t in texts]


@pytest.mark.parametrize("digits,alpha", [(4, 1.0), (1, 0.25)])
def test_text_scores(spark, digits, alpha):
    draw = random.Random(digits)
    train = [(" ".join(draw.choices(POOL, weights=range(1, 9) if k % 3 else range(9, 1, -1), k=draw.randint(0, 20))), "ab"[k % 3 == 0]) for k in range(90)]
    train += [(None, "c"), ("", "c"), ("preis", None)]
    asked = [" ".join(draw.choices([*POOL, "neu"], k=draw.randint(0, 9))) for _ in range(60)] + [None, "", "!"]
    model = bayes.train_texts(spark, spark.createDataFrame(train, "text string, label string"), digits=digits, alpha=alpha)
    df = spark.createDataFrame(list(enumerate(asked)), "id int, text string").withColumn("feature", F.lit("x"))
    got, names = bayes.scores(model, df, "id", "text", digits)
    want_names, want = plain_scores(train, asked, digits, alpha)
    assert names == want_names
    for row in got.collect():
        assert row["scores"] == pytest.approx(want[row["id"]], abs=1e-9)
    labels = {r["id"]: r["predicted_label"] for r in bayes.predict(model, df, "id", "text", "m", digits=digits).collect()}
    assert labels == {i: want_names[max(range(len(s)), key=lambda k: (s[k], -k))] for i, s in enumerate(want)}


def test_vector_scores(spark):
    draw = random.Random(5)
    train = [([draw.gauss(k % 3, 1 + k % 2) for _ in range(4)], "abc"[k % 3]) for k in range(120)]
    train += [([1.0, 2.0, None, float("nan")], "a"), (None, "b"), ([], "c"), ([7.0] * 4, None)]
    asked = [[draw.gauss(1, 2) for _ in range(4)] for _ in range(40)] + [[None, 1.0, float("nan"), 0.0], [1.0] * 6, [], None]
    model = bayes.train_vectors(spark, spark.createDataFrame(train, "embedding array<double>, label string"))
    got, names = bayes.scores(model, spark.createDataFrame(list(enumerate(asked)), "id int, v array<double>"), "id", "v")
    cells = defaultdict(list)
    for v, label in train:
        for k, x in enumerate(v or []):
            if label is not None and x is not None and not math.isnan(x):
                cells[label, k].append(x)
    rows = Counter(label for _, label in train if label is not None)
    for row in got.collect():
        for c, score in zip(names, row["scores"]):
            want = math.log(rows[c] / rows.total())
            for k, x in enumerate(asked[row["id"]] or []):
                if x is not None and not math.isnan(x) and (c, k) in cells:
                    m = sum(cells[c, k]) / len(cells[c, k])
                    v = max(sum((y - m) ** 2 for y in cells[c, k]) / len(cells[c, k]), 1e-9)
                    want -= (x - m) ** 2 / (2 * v) + math.log(2 * math.pi * v) / 2
            assert score == pytest.approx(want, abs=1e-6)
    assert got.count() == len(asked)


def test_saved_models_and_empty_tables(spark, tmp_path):
    train = spark.createDataFrame([("a b", "x"), ("b c", "y")], "text string, label string")
    asked = spark.createDataFrame([(1, "a a", "k"), (2, "c", None)], "id int, text string, more string")
    model = bayes.train_texts(spark, train)
    model.save(str(tmp_path / "m"))
    loaded = bayes.BayesModel.load(spark, str(tmp_path / "m"))
    for m in (model, loaded):
        got = {tuple(r) for r in bayes.predict(m, asked, "id", "text", "n", ("more",)).collect()}
        assert got == {(1, "k", "x", "n"), (2, None, "y", "n")}
    assert bayes.predict(model, asked.where("false"), "id", "text", "n").count() == 0
    none = bayes.train_texts(spark, train.where("false"))
    assert [r["predicted_label"] for r in bayes.predict(none, asked, "id", "text", "n").collect()] == [None, None]
    assert bayes.train_vectors(spark, spark.createDataFrame([], "embedding array<float>, label string")).features.count() == 0


def test_too_many_classes(spark):
    train = spark.createDataFrame([("w", str(k)) for k in range(5)], "text string, label string")
    with pytest.raises(ValueError):
        bayes._class_names(bayes.train_texts(spark, train), most=4)


def test_texts_are_not_shuffled(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "id int, text string, label string")
    model = bayes.train_texts(spark, df)
    plan = bayes.predict(model, df, "id", "text", "n", ("label",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and plan.count("Generate explode") == 1
