import math
import random

from tallymark.operators import metrics

rng = random.Random(2)


def expected(pairs):
    classes = {t for t, _ in pairs} | {p for _, p in pairs}
    per = []
    for c in classes:
        tp = sum(t == c and p == c for t, p in pairs)
        predicted, true = sum(p == c for _, p in pairs), sum(t == c for t, _ in pairs)
        pr, re = tp / predicted if predicted else 0.0, tp / true if true else 0.0
        per.append((pr, re, 2 * pr * re / (pr + re) if pr + re else 0.0, true, predicted))
    n, right = len(pairs), sum(t == p for t, p in pairs)
    accuracy = right / n
    low = (n * n - sum(x[4] ** 2 for x in per)) * (n * n - sum(x[3] ** 2 for x in per))
    mcc = (right * n - sum(x[3] * x[4] for x in per)) / math.sqrt(low) if low else 0.0
    mean = [sum(x[k] for x in per) / len(per) for k in range(3)]
    return {"accuracy": accuracy, "macro-precision": mean[0], "macro-recall": mean[1], "macro-f1": mean[2],
            "micro-precision": accuracy, "micro-recall": accuracy, "micro-f1": accuracy, "matthews_corrcoef": mcc}


def test_metrics_against_definitions(spark):
    groups = {
        "many": [(rng.choice("abc"), rng.choice("abcd")) for _ in range(200)],
        "one class": [("a", "a")] * 5,
        "all wrong": [("a", "b"), ("b", "a")],
        "good": [(c, c if rng.random() < 0.9 else "a") for c in rng.choices("ab", k=50)],
    }
    rows = [(g, t, p) for g, pairs in groups.items() for t, p in pairs]
    df = spark.createDataFrame(rows, "g string, t string, p string")
    long = metrics.long_metrics(metrics.wide_metrics(df, "t", "p", ("g",)), ("g",)).collect()
    assert len(long) == len(groups) * len(metrics.METRICS)
    for r in long:
        assert abs(r["score"] - expected(groups[r["g"]])[r["metric"]]) < 1e-12, r
    only = df.where("g = 'many'")
    assert abs(metrics.macro_f1(only, "t", "p").first()[0] - expected(groups["many"])["macro-f1"]) < 1e-12


def test_report_rows_and_compat(spark):
    pairs = [(1, 1)] * 6 + [(1, 0)] * 3 + [(0, 0)] * 4
    df = spark.createDataFrame(pairs, "t int, p int")
    right = {r["Metric"]: r["score"] for r in metrics.report(df, "t", "p").collect()}
    compat = {r["Metric"]: r["score"] for r in metrics.report(df, "t", "p", compat=True).collect()}
    want = expected(pairs)
    assert right["Macro-R"] == round(want["macro-recall"] * 100, 2)
    assert right["ACC"] == right["Micro-R"] == round(want["accuracy"] * 100, 2)
    assert compat["Macro-R"] == compat["Micro-R"] == compat["Macro-P"] == right["Macro-P"] != right["Macro-R"]


def test_scopes_follow_the_file_name(spark):
    # "shared" lies in both splits; most rows have that name, so it is a hot key.
    splits = spark.createDataFrame(
        [("shared", "validation"), ("shared", "test"), ("v", "validation"), ("t", "test"), ("x", "train")],
        "filename string, split string")
    rows = [(i, ["shared", "shared", "v", "t", "x", "none"][i % 6], rng.choice(["has_criteria", "has_no_criteria", None]),
             rng.choice(["has_criteria", "ja"])) for i in range(300)]
    df = spark.createDataFrame(rows, "row_idx int, filename string, label string, label_predicted string")
    names = {"Validation": {"shared", "v"}, "Test": {"shared", "t"}, "All": {r[1] for r in rows}}
    got = {r["Metric"]: r for r in metrics.binary_report(df, splits).collect()}
    for scope, wanted in names.items():
        pairs = [(int(l == "has_criteria"), int(p == "has_criteria")) for _, f, l, p in rows if f in wanted]
        want = expected(pairs)
        assert abs(got["ACC"][scope] - want["accuracy"] * 100) < 0.0051
        assert abs(got["MCC"][scope] - want["matthews_corrcoef"] * 100) < 0.0051
    found = metrics.rows_of_split(df, splits, "validation").collect()
    assert sorted(r["row_idx"] for r in found) == [r[0] for r in rows if r[1] in names["Validation"]]


def test_side_by_side_matches_by_name(spark):
    a = spark.createDataFrame([("x", 0.5), ("y", 0.25)], "metric string, score double")
    b = spark.createDataFrame([("y", 1.0), ("x", 0.125)], "metric string, score double")
    assert {tuple(r) for r in metrics.side_by_side(a, b).collect()} == {("x", 50.0, 12.5), ("y", 25.0, 100.0)}
