"""The search that learns from its trials: sampler, early stopping, and its use with the word classifier."""

import math

import pytest
from pyspark.sql import functions as F

from tallymark.operators import classify, search

SPACE = {"a": ("log", 1e-3, 1e3), "b": ("int", 1, 5), "c": ("choice", ("x", "y", "z"))}


def hill(params, rung=0):
    """Best at a = 1, b = 4, c = y."""
    return -abs(math.log10(params["a"])) - abs(params["b"] - 4) / 2 - (params["c"] != "y")


def test_values_lie_in_their_ranges():
    assert search.value_of(("log", 1e-3, 1e3), 0.5) == pytest.approx(1.0)
    assert [search.value_of(("int", 1, 5), u) for u in (0, 0.19, 0.2, 0.999, 1.0)] == [1, 1, 2, 5, 5]
    assert [search.value_of(("choice", "xyz"), u) for u in (0, 0.4, 1.0)] == ["x", "y", "z"]
    with pytest.raises(ValueError):
        search.value_of(("other",), 0.1)
    for t in search.run_search(hill, SPACE, 30):
        assert 1e-3 <= t.params["a"] <= 1e3 and 1 <= t.params["b"] <= 5 and t.params["c"] in "xyz"
        assert all(0 <= u <= 1 for u in t.units.values())


def test_same_seed_same_trials():
    first, again = (search.run_search(hill, SPACE, 15, seed=3) for _ in range(2))
    assert [(t.params, t.scores) for t in first] == [(t.params, t.scores) for t in again]
    assert [t.params for t in search.run_search(hill, SPACE, 15, seed=4)] != [t.params for t in first]


def test_learning_beats_random_draws():
    """Later trials are better than random ones on average, over many seeds."""
    learned, drawn = [], []
    for seed in range(30):
        trials = search.run_search(hill, SPACE, 30, seed=seed)
        learned += [t.scores[-1] for t in trials[15:]]
        drawn += [hill({n: search.value_of(r, search.uniform(seed, k, n, 0)) for n, r in SPACE.items()}) for k in range(15, 30)]
    assert sum(learned) / len(learned) > sum(drawn) / len(drawn) + 0.5


def test_weights_are_dense_where_places_are():
    assert search.weights([2, 2, 7], 8, True) == [1, 1.5 + 0.5, 3, 2, 1, 1, 1.5, 2]
    assert search.weights([2], 3, False) == [1, 1, 2]


def test_poor_trials_stop_early():
    """A trial passes a rung only among the best third so far; scores that are no number are the worst."""
    calls = []

    def objective(params, rung):
        calls.append(rung)
        return [5.0, 1.0, 9.0, math.nan, 9.0][len([c for c in calls if c == 0]) - 1] + rung

    trials = search.run_search(objective, SPACE, 5, rungs=3)
    assert [len(t.scores) for t in trials] == [3, 1, 3, 1, 3]
    assert trials[3].scores == [-math.inf] and search.best_trial(trials).number == 2


def test_adaptive_search_of_the_word_classifier(spark):
    words = {"x": "preis wert gut", "y": "frist tag ort"}
    rows = [(f"k{i}", f"{words['xy'[i % 2]]} w{i % 7}", i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "text_key string, text string, label_id int")
    train, held_out = df.where(F.col("text_key") < "k4"), df.where(F.col("text_key") >= "k4")
    space = {"reg_param": ("log", 1e-3, 1e-1), "max_iter": ("int", 5, 10), "elastic_net": ("choice", (0.0,))}
    model, params, history = classify.search_adaptively(train, held_out, 3, space=space)
    best = search.best_trial(history)
    assert params == best.params and len(best.scores) == 2 and best.scores[-1] == 1.0
    found = model.transform(held_out).where(F.col("label_id") != F.col("_prediction")).count()
    assert found == 0
    with pytest.raises(ValueError):
        classify.search_adaptively(train, held_out, 1, shares=(0.5,))
