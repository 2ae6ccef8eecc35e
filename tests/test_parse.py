"""Parsing of generated answers, with the edge rows of FIXTURES.md."""

import pytest
from pyspark.sql import functions as F

from tallymark.functions import parse
from tallymark.functions.parse import cleaned_answer, first_list, with_parsed_answer

FAIL = None
# id, answer, records in exact mode, records in native mode (normalised, empty records dropped)
GOLDEN = [
    ("E1", '```json\n[{"zkNummer":"ZK1","kriterium":"Preis","gewichtung":"40%","maxPunkte":null}]```',
     [{"zkNummer": "1", "kriterium": "Preis", "gewichtung": "40", "maxPunkte": ""}], "same"),
    ("E2", "[{'kriterium':'Qua-\nlität'}]", [{"kriterium": "Qualität"}], "same"),
    ("E3", 'Hier: [1, {"kriterium":"Preis"}] Ende', [{"kriterium": "Preis"}], "same"),
    ("E4", '[[{"kriterium":"A"}] ]', [{"kriterium": "A"}], "same"),
    ("E5", '{"kriterium":"A"}', [], FAIL),
    ("E6", "Nein.", FAIL, FAIL),
    ("E7", "[{}]", [], "same"),
    ("E8", '[{"kriterium":true}]', FAIL, [{"kriterium": "true"}]),
    ("E9", '[{"kriterium":"A [x]"}]', FAIL, FAIL),
    ("E10", '[{"kriterium":"annulliert"}]', [{"kriterium": "an''iert"}], "same"),
    ("E11", '[{"kriterium":"A"},]', [{"kriterium": "A"}], FAIL),
    ("E12", "[]", [], "same"),
    ("E13", '[{"a":"1","a":"2"}]', [{"a": "2"}], "same"),
    ("E14", '[{"maxPunkte":30.0}]', [{"maxPunkte": "30.0"}], [{"maxPunkte": "300"}]),
    ("E15", '[{"a":"x"}] und [{"b":"y"}]', [{"a": "x"}], "same"),
    ("E16", "5", FAIL, FAIL),
    ("E17", '"abc"', [], FAIL),
    ("E18", '[{"kriterium":"A [1]"}]', [], "same"),
    ("object as text", """['{"a":"1"}', {"b":"2"}]""", [{"b": "2"}], [{"a": "1"}, {"b": "2"}]),
    ("None", '[{"kriterium":None,"maxPunkte":"5 P"}]', [{"kriterium": "", "maxPunkte": "5"}], FAIL),
    ("zero only", '[{"maxPunkte":0}]', [], [{"maxPunkte": "0"}]),
    ("escape", r'[{"kriterium":"a\/b"}]', [{"kriterium": r"a\/b"}], [{"kriterium": "a/b"}]),
    ("joined strings", "[{'kriterium':'a' 'b'}]", [{"kriterium": "ab"}], FAIL),
    ("apostrophe", '[{"kriterium":"l\'eau"}]', [{"kriterium": "l'eau"}], "same"),
    ("inner object", '[{"kriterium":"A","x":{"y":"z"}}]', [{"kriterium": "A", "x": "{'y': 'z'}"}],
     [{"kriterium": "A", "x": '{"y":"z"}'}]),
    ("letters only", '[{"zkNummer":"ZK"},{"zkNummer":"A1"}]', [{"zkNummer": "1"}], "same"),
    ("NaN", '[{"kriterium":NaN}]', FAIL, [{"kriterium": "NaN"}]),
    ("empty", "", FAIL, FAIL),
]


@pytest.mark.parametrize("mode", ["exact", "native"])
def test_golden_rows(spark, mode):
    df = spark.createDataFrame([(i, a) for i, a, _, _ in GOLDEN], "id string, pred_output_as_string string")
    got = {r["id"]: r for r in with_parsed_answer(df, mode=mode).collect()}
    for key, _, exact, native in GOLDEN:
        want = exact if mode == "exact" or native == "same" else native
        row = got[key]
        assert row["y_pred"] == want, key
        assert row["conversion_status"] == ("failed" if want is None else "ok"), key
        assert bool(row["error_message"]) == (want is None), key


def test_exact_mode_has_one_python_step(spark):
    df = spark.createDataFrame([('[{"kriterium":"A"}]',)], "pred_output_as_string string")
    plan = with_parsed_answer(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_python_reads_only_what_the_jvm_cannot(spark):
    """Of the golden rows Python reads the joined strings, the inner object and the odd escape, and the list with an object as text."""
    df = spark.createDataFrame([(i, a) for i, a, _, _ in GOLDEN], "id string, answer string")
    staged = df.select("id", first_list(cleaned_answer(F.col("answer"))).alias("_text"))
    left = {r["id"] for r in parse._read_exactly(staged).where("_unread").collect()}
    assert left == {"joined strings", "inner object", "escape", "object as text"}


def test_long_literals(spark):
    """Ten thousand records with numbers, and a string of a million letters, need no deep stack."""
    many = "[" + ", ".join(f"{{'kriterium': 'k{i}', 'maxPunkte': {i}.5,}}" for i in range(10000)) + "]"
    long = "[{'kriterium': None, 'x': '" + "a\\'b " * 250000 + "'}]"
    df = spark.createDataFrame([(1, many), (2, long)], "id int, answer string")
    got = {r["id"]: r["y_pred"] for r in with_parsed_answer(df, "answer").collect()}
    assert len(got[1]) == 10000 and got[1][7] == {"kriterium": "k7", "maxPunkte": "7.5"}
    assert got[2] == [{"kriterium": "", "x": "a'b " * 250000}]


def test_null_answer_fails(spark):
    df = spark.createDataFrame([(None,)], "pred_output_as_string string")
    for mode in ("exact", "native"):
        row = with_parsed_answer(df, mode=mode).first()
        assert (row["conversion_status"], row["y_pred"]) == ("failed", None) and row["error_message"]


def test_null_words(spark):
    df = spark.createDataFrame([('[{"a": null, "b": "annulliert"}]',)], "x string")
    compat, fixed = df.select(cleaned_answer(F.col("x")), cleaned_answer(F.col("x"), "fixed")).first()
    assert compat == """[{"a": '', "b": "an''iert"}]"""
    assert fixed == """[{"a": '', "b": "annulliert"}]"""


def test_first_list(spark):
    df = spark.createDataFrame([("a [1] [2]", ), ("none",), ("[x [y] z",)], "x string")
    assert [r[0] for r in df.select(first_list(F.col("x"))).collect()] == ["[1]", "none", "[y]"]


def test_only_plain_lists_reach_the_first_json_parser(spark):
    """What the parser would throw on is told by its shape before."""
    texts = {'[{"a":"b"}]': True, "[ { 'a' : '' , \"b\":\"c\"} , {} ]": True, "[]": True, "[{}]": True, "Nein.": False, "[x]": False,
             '[{"a":"b"},]': False, '[1, {"a":"b"}]': False, '{"a":"b"}': False, '[{"a":true}]': False, '[{"a":"b" "c"}]': False, "": False}
    df = spark.createDataFrame([(t,) for t in texts], "_text string")
    assert {r[0]: r[1] is not None for r in df.select("_text", parse._plain_text(F.col("_text"))).collect()} == texts


def test_annotated_records_are_cleaned_above_the_reading(spark, tmp_path):
    """The reading copies its rows step by step; what does not need it is made after it."""
    from tallymark.plans import catalog

    spark.sql("SELECT 1L AS l_orderkey, 2L AS l_partkey, 3L AS l_suppkey, 1 AS l_linenumber, 4D AS l_quantity, 0.05D AS l_discount, "
              "'A' AS l_returnflag, 'F' AS l_linestatus").write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalog._parsed(spark, str(tmp_path)).select("y_true", "y_pred")
    above, below = df._jdf.queryExecution().executedPlan().toString().split("ArrowEvalPython", 1)
    assert "y_true" in above and "y_true" not in below
    assert df.first()["y_true"] == [{"zkNummer": "1", "kriterium": "Preis AF", "gewichtung": "5", "maxPunkte": "4"}]
