import random

from pyspark.sql import functions as F

from tallymark.fixed import FIELDS, FIELD_TITLES, SCORE_FIELDS
from tallymark.functions.scores import pair_scores, scores_from_counts, set_counts
from tallymark.operators import scoring


def by_label(truth: set, found: set) -> dict:
    """The scores from their definitions: one row of indicators, averaged over labels."""
    if truth == found:
        return dict.fromkeys(SCORE_FIELDS, 1.0)
    labels = sorted(truth | found)
    per = []
    for label in labels:
        tp, fp, fn = label in truth & found, label in found - truth, label in truth - found
        p = tp / (tp + fp) if tp + fp else 0.0
        r = tp / (tp + fn) if tp + fn else 0.0
        per.append((p, r, 2 * p * r / (p + r) if p + r else 0.0, int(label in truth)))
    tp = len(truth & found)
    micro_p = tp / len(found) if found else 0.0
    micro_r = tp / len(truth) if truth else 0.0
    support = sum(x[3] for x in per)
    out = {"accuracy_not_normalized": 0.0, "accuracy_normalized": 0.0, "precision_micro": micro_p,
           "recall_micro": micro_r, "f1_micro": 2 * micro_p * micro_r / (micro_p + micro_r) if tp else 0.0}
    for place, name in enumerate(("precision", "recall", "f1")):
        out[f"{name}_macro"] = sum(x[place] for x in per) / len(per)
        out[f"{name}_weighted"] = sum(x[place] * x[3] for x in per) / support if support else 0.0
    return out


def close(row, want):
    return all(abs(row[m] - want[m]) < 1e-12 for m in SCORE_FIELDS)


def test_closed_form_against_definitions(spark):
    rng = random.Random(7)
    sets = [(set(rng.sample("abcdefgh", rng.randint(0, 6))), set(rng.sample("abcdefgh", rng.randint(0, 6))))
            for _ in range(400)]
    sets += [(set(), set()), (set("ab"), set("ab")), (set("ab"), set("ac")), (set("ab"), set()), (set(), set("a")),
             (set("a"), set("abc"))]
    df = spark.createDataFrame([(i, sorted(t), sorted(p)) for i, (t, p) in enumerate(sets)],
                               "i int, t array<string>, p array<string>")
    counted = df.select("i", set_counts(F.col("t"), F.col("p")).alias("c"))
    for row in counted.select("i", scores_from_counts("c").alias("s")).collect():
        assert close(row["s"], by_label(*sets[row["i"]])), sets[row["i"]]
        assert row["s"]["f1_macro"] <= row["s"]["f1_micro"] + 1e-12


def test_record_and_field_scores(spark):
    schema = "y_true array<map<string,string>>, y_pred array<map<string,string>>"
    df = spark.createDataFrame([
        ([{"kriterium": "A", "gewichtung": "1"}, {"kriterium": "B"}], [{"kriterium": "A"}, {"kriterium": "B"}]),
        ([], None), ([{"kriterium": "A"}], None), ([{"kriterium": "A"}, {"kriterium": "A"}], [{"kriterium": "A"}]),
    ], schema)
    rows = scoring.with_scores(df).collect()
    assert close(rows[0]["key_value_eval"], by_label({"A1", "B"}, {"A", "B"}))
    assert close(rows[0]["span_scores"]["kriterium"], by_label({"A", "B"}, {"A", "B"}))
    assert close(rows[0]["span_scores"]["gewichtung"], by_label({"1"}, set()))
    assert rows[1]["key_value_eval"]["f1_macro"] == 1.0  # nothing annotated, nothing parsed
    assert rows[2]["key_value_eval"]["f1_macro"] == 0.0
    assert rows[3]["key_value_eval"]["f1_macro"] == 1.0  # repeated records count once


def test_long_scores_with_a_hot_page(spark):
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 1, 2, 3]), f"k{rng.randint(0, 30)}", rng.random() < 0.7, rng.random() < 0.6)
            for _ in range(3000)]
    df = spark.createDataFrame(rows, "page int, k string, t boolean, p boolean")
    keys = scoring.key_rows(df, "page", F.when(F.col("t"), F.col("k")), F.when(F.col("p"), F.col("k")))
    pages = spark.createDataFrame([(i,) for i in range(5)], "page int")
    got = {r["page"]: r["score"] for r in scoring.long_scores(pages, keys, "page").collect()}
    for page in range(5):
        truth = {k for q, k, t, _ in rows if q == page and t}
        found = {k for q, k, _, p in rows if q == page and p}
        assert close(got[page], by_label(truth, found))


def test_pair_scores(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"}, {"a": "1", "c": "2"}), ({}, {}), ({"a": "1"}, {"b": "1"})],
                               "t map<string,string>, g map<string,string>")
    got = [tuple(r[0]) for r in df.select(pair_scores(F.col("t"), F.col("g"))).collect()]
    assert got == [(0.5, 0.5, 0.5), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]


def test_field_views(spark):
    df = spark.createDataFrame([(1, [{"kriterium": "A"}], None)],
                               "id int, y_true array<map<string,string>>, y_pred array<map<string,string>>")
    got = {r["label_view"]: r for r in scoring.with_field_views(df).collect()}
    assert set(got) == {"None", *FIELDS}
    assert got["kriterium"]["y_true_as_string"] == "Zuschlagskriterium ist A. "
    assert got["gewichtung"]["y_true_as_string"] == "Gewichtung ist . "
    assert got["kriterium"]["y_pred"] is None and got["kriterium"]["y_pred_as_string"] == ""


def test_field_views_are_made_in_compiled_steps(spark):
    """Lists of every length to beyond what is spelled out, with missing fields, empty texts and a null record, against the plain definition."""
    lists = [None, [], [None], [{"kriterium": "b", "gewichtung": ""}, {"kriterium": "a!"}, {"kriterium": "a"}, {"x": "y"}, {"zkNummer": "9"}]]
    lists += [[{"kriterium": str(7 * i % 5), "maxPunkte": str(i)} for i in range(n)] for n in range(1, 8)]
    rows = [(i, t, lists[-1 - i]) for i, t in enumerate(lists)]
    df = spark.createDataFrame(rows, "id int, y_true array<map<string,string>>, y_pred array<map<string,string>>")

    def text(records, fields):
        return " ".join(sorted("".join(f"{FIELD_TITLES[f]} ist {r[f]}. " for f in fields if f in r) for r in records or []))

    views = scoring.with_field_views(df)
    got = {(r["id"], r["label_view"]): r for r in views.collect()}
    assert len(got) == 5 * len(lists) and views.columns == ["id", "label_view", "y_true", "y_pred", "y_true_as_string", "y_pred_as_string"]
    for i, *sides in rows:
        for name, records in zip(("y_true", "y_pred"), sides):
            assert got[i, "None"][name] == records
            assert got[i, "None"][f"{name}_as_string"] == text([r or {} for r in records or []], FIELDS)
            for f in FIELDS:
                one = None if records is None else [{f: (r or {}).get(f, "")} for r in records]
                assert got[i, f][name] == one and got[i, f][f"{name}_as_string"] == text(one, [f])
    plan = views._jdf.queryExecution().executedPlan().toString()
    assert [line for line in plan.split("\n") if "Generate explode" in line and "lambda" not in line]


def lcs(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


def test_rouge_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 90))), " ".join(rng.choices("abcdf", k=rng.randint(0, 90))))
            for i in range(40)] + [(90, "", ""), (91, "Ä ö!", "a")]
    df = spark.createDataFrame(rows, "i int, r string, c string")
    one = {r["i"]: r for r in scoring.rouge1(df, "i", "r", "c").collect()}
    long = {r["i"]: r for r in scoring.rouge_l(df, "i", "r", "c").collect()}
    for i, r, c in rows:
        a, b = ([t for t in x.split() if t.isascii()] for x in (r, c))
        hits = sum(min(a.count(t), b.count(t)) for t in set(a))
        for got, h in ((one[i], hits), (long[i], lcs(a, b))):
            assert got["precision"] == (h / len(b) if b else 0.0)
            assert got["recall"] == (h / len(a) if a else 0.0)
