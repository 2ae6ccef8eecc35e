import json

import pytest
from pyspark.sql import functions as F

from tallymark.functions import text as X


def values(spark, items, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(items)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_labels_and_digits(spark):
    assert values(spark, ["has_criteria?", "a??b", None], X.clean_label) == ["has_criteria", "ab", None]
    assert values(spark, ["ZK 1.1", "33.3%", "", "٣ Punkte", "x"], X.digits_only) == ["11", "333", "", "٣", ""]


def test_strip_takes_all_white_space(spark):
    raw = [" \n\tJa\r\n", " x ", "\x1cy\x1f", "a b", " \n "]
    assert values(spark, raw, X.stripped) == [r.strip() for r in raw]
    assert values(spark, [" NEIN\n"], X.lower_stripped) == ["nein"]


def test_broken_words(spark):
    raw = ["Qua-\nlität", "A\n-B", "A- \nB", "-\n-"]
    want = [r.replace("\n-", "").replace("-\n", "") for r in raw]
    assert values(spark, raw, X.join_broken_words) == want


def test_flags(spark):
    assert values(spark, ["yes", "T", "1", "No", "f", "0", None], X.parse_flag) == [
        True, True, True, False, False, False, None]
    with pytest.raises(Exception, match="Boolean value expected"):
        values(spark, ["maybe"], X.parse_flag)


def test_percent_and_names(spark):
    df = spark.createDataFrame([(0.12345, "prompt_1"), (1.0, "other")], "s double, p string")
    rows = df.select(X.as_percent(F.col("s")), X.display_name(F.col("p"), {"prompt_1": "1"})).collect()
    assert [tuple(r) for r in rows] == [(12.35, "1"), (100.0, None)]


def test_json_strings_match_the_json_module(spark):
    raw = ['a"b', "ä", "x\\y", "l\n\t\r\b\f", "\x01\x7f", "€ 5", "𝄞", "", "null"]
    assert values(spark, raw, X.python_json_string) == [json.dumps(r) for r in raw]


def test_letters_are_escaped_as_python_does(spark):
    """Alone and in records: what stays as it is, German letters, control characters, other scripts and pairs of units."""
    import json

    from tallymark.functions.records import record_json
    from tallymark.functions.text import needs_escapes, python_json_string

    texts = ["plain [x] ~!#", "", "Qualität Größe ÄÖÜ", 'a"b', "a\\b", "\x7f\x00\x1f", "\t\n\r\b\f", "ä\\u00e4", "日本 ä", "😀é"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").cache()
    assert [r[0] for r in df.select(python_json_string(F.col("x"))).collect()] == [json.dumps(t) for t in texts]
    assert [r[0] for r in df.select(needs_escapes(F.col("x"))).collect()] == [False, False] + [True] * 8
    record = F.create_map(F.lit("k"), F.lit("v"), F.lit("a"), F.col("x"))
    assert [r[0] for r in df.select(record_json(record)).collect()] == [json.dumps({"a": t, "k": "v"}) for t in texts]
