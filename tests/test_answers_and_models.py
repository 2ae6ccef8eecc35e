import math
import random

import pytest
from pyspark.sql import functions as F

from tallymark.functions import answers as A
from tallymark.functions.vectors import label_catalogue, nearest_label
from tallymark.operators import classify, prepare

rng = random.Random(8)


def test_presence_labels(spark):
    df = spark.createDataFrame(
        [(" Ja.", "nein"), ("\nNEIN", "ja"), ("Vielleicht", "ja"), ("?", "nein"), ("jawohl", None)], "a string, n string")
    fixed = [r[0] for r in df.select(A.presence_label(F.col("a"), F.col("n"))).collect()]
    compat = [r[0] for r in df.select(A.presence_label(F.col("a"), F.col("n"), "compat")).collect()]
    alone = [r[0] for r in df.select(A.presence_label(F.col("a"))).collect()]
    assert fixed == ["has_criteria", "has_no_criteria", "has_criteria", "has_no_criteria", "has_criteria"]
    assert compat == ["has_criteria", "has_no_criteria", "ja", "nein", "has_criteria"]
    assert alone == ["has_criteria", "has_no_criteria", None, None, "has_criteria"]
    with pytest.raises(ValueError):
        A.presence_label(F.col("a"), F.col("n"), "other")


def test_binary_and_argmax(spark):
    df = spark.createDataFrame([("has_criteria", [0.2, 0.5, 0.5]), (None, [0.9, 0.1]), ("ja", [0.0])],
                               "l string, p array<double>")
    got = df.select(A.is_positive(F.col("l")), A.best_class(F.col("p")),
                    A.decode_class(A.best_class(F.col("p")), {0: "x", 1: "y"})).collect()
    assert [tuple(r) for r in got] == [(1, 1, "y"), (0, 0, "x"), (0, 0, "x")]


def test_nearest_label(spark):
    vectors = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(30)] + [[0.0] * 6]
    catalogue = [("ja", vectors[0]), ("nein", vectors[1]), ("other", vectors[2])]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "i int, v array<double>")

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    for r in df.select("i", "v", nearest_label(F.col("v"), catalogue).alias("n")).collect():
        if r["i"] == 30:
            assert tuple(r["n"]) == ("ja", 0.0)
            continue
        best = max(catalogue, key=lambda c: cosine(r["v"], c[1]))
        assert r["n"]["label"] == best[0] and abs(r["n"]["score"] - cosine(r["v"], best[1])) < 1e-12
    some = spark.createDataFrame([(1, None), (2, vectors[1]), (3, None)], "i int, v array<double>")
    got = {r["i"]: r["n"] for r in some.select("i", nearest_label(F.col("v"), catalogue).alias("n")).collect()}
    assert got[1] is None and got[3] is None and got[2]["label"] == "nein"
    named = df.withColumn("l", (F.col("i") % 2).cast("string"))
    assert label_catalogue(named, "l", "v", "i", ("1", "0")) == [("0", vectors[0]), ("1", vectors[1])]
    with pytest.raises(ValueError, match="no vector"):
        label_catalogue(named, "l", "v", "i", ("0", "2"))



def texts(spark):
    words = {"has_criteria": "preis gewicht punkte kriterium".split(), "has_no_criteria": "vertrag norm plan ort".split()}
    rows = []
    for i in range(200):
        label = rng.choice(list(words))
        rows.append((i, f"f{i}", " ".join(rng.choices(words[label], k=6)) + f" x{i}", label))
    return spark.createDataFrame(rows, "row_idx long, filename string, text string, label string")


def test_training_prediction_and_saving(spark, tmp_path):
    rows = prepare.prepare(texts(spark), ("row_idx", "filename", "text")).cache()
    names = classify.class_table(rows)
    assert sorted(map(tuple, names.collect())) == [(0, "has_criteria"), (1, "has_no_criteria")]
    model = classify.train(rows.where("split = 'train'"), {"max_iter": 20})
    unseen = rows.where("split <> 'train'")
    found = classify.predict(model, unseen, names, "m")
    assert found.where("label = predicted_label").count() >= 0.9 * unseen.count()
    again = classify.train(rows.where("split = 'train'"), {"max_iter": 20})
    assert found.exceptAll(classify.predict(again, unseen, names, "m")).count() == 0
    path = classify.save_model(model, str(tmp_path), "criteria_relevance", "a/b")
    assert path.endswith("/criteria_relevance/a_b")
    loaded = classify.load_model(str(tmp_path), "criteria_relevance", "a/b")
    assert found.exceptAll(classify.predict(loaded, unseen, names, "m")).count() == 0


def test_search_takes_the_best_trial(spark):
    rows = prepare.prepare(texts(spark), ("row_idx", "filename", "text")).cache()
    _, best, trials = classify.search(rows.where("split = 'train'"), rows.where("split = 'validation'"), 2)
    assert max(t["macro_f1"] for t in trials) == next(
        t["macro_f1"] for t in trials if all(t[k] == v for k, v in best.items()))
    assert classify.draw_params(3, 1) == classify.draw_params(3, 1) != classify.draw_params(3, 2)
    for p in classify.draw_params(50, 1):
        assert 1e-4 <= p["reg_param"] <= 1e-1 and 10 <= p["max_iter"] <= 60


def test_words_keep_their_umlauts(spark):
    words = classify.text_stages()[0].transform(spark.createDataFrame([("für Qualität größer, 20%",)], "text string"))
    assert words.first()["_words"] == ["für", "qualität", "größer", "20"]


def test_training_from_stored_counts_is_the_same(spark):
    """The model of ``train`` is that of a plain pipeline over the same stages."""
    from pyspark.ml import Pipeline

    rows = [(f"wort{i % 5} preis{i % 3} " + "und " * (i % 4), i % 2) for i in range(40)] + [(None, 0), ("", 1)]
    df = spark.createDataFrame([(t or "", y) for t, y in rows], "text string, label_id int")
    ours = classify.train(df, {"reg_param": 0.01})
    plain = Pipeline(stages=[*classify.text_stages("text"), classify.head({"reg_param": 0.01})]).fit(df)
    assert len(ours.stages) == len(plain.stages) == 4
    a, b = ([r["probability"][1] for r in m.transform(df).orderBy("text").collect()] for m in (ours, plain))
    assert a == pytest.approx(b, abs=1e-9)
