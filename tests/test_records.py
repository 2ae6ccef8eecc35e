import json

from pyspark.sql import functions as F

from tallymark.fixed import FIELD_TITLES
from tallymark.functions import records as R

LISTS = [
    [{"zkNummer": "ZK 1", "kriterium": "Qua-\nlität", "gewichtung": "40%", "maxPunkte": "5 P."}],
    [{"kriterium": "B"}, {"kriterium": "A", "gewichtung": ""}],
    [{"zkNummer": "", "kriterium": ""}, {"kriterium": "C"}],
    [],
    None,
    [{"other": "x"}],
    [{"zkNummer": "ZK"}],
    [{"kriterium": None, "maxPunkte": "3"}],
]


def run(spark, *columns):
    df = spark.createDataFrame(list(enumerate(LISTS)), "i int, r array<map<string,string>>")
    return [tuple(row) for row in df.orderBy("i").select(*columns).collect()]


def test_normalized_and_dropped(spark):
    got = [r[0] for r in run(spark, R.normalized(F.col("r")))]
    assert got == [
        [{"zkNummer": "1", "kriterium": "Qualität", "gewichtung": "40", "maxPunkte": "5"}],
        [{"kriterium": "B"}, {"kriterium": "A", "gewichtung": ""}],
        [{"kriterium": "C"}],
        [], None,
        [{"other": "x"}],
        [],  # nothing is left without its letters
        [{"kriterium": "", "maxPunkte": "3"}],
    ]


def test_text_is_sorted_and_keeps_field_order(spark):
    got = [r[0] for r in run(spark, R.records_text(F.col("r")))]
    assert got[1] == "Zuschlagskriterium ist A. Gewichtung ist .  Zuschlagskriterium ist B. "
    assert got[3] == "" and got[4] is None and got[5] == ""
    assert list(FIELD_TITLES) == ["zkNummer", "kriterium", "gewichtung", "maxPunkte"]


def test_json_matches_the_json_module(spark):
    got = [r[0] for r in run(spark, R.records_json(F.col("r")))]
    for records, text in zip(LISTS[:4], got[:4]):
        inner = sorted(json.dumps(dict(sorted(r.items()))) for r in records)
        assert text == json.dumps(sorted(json.dumps(t) for t in inner), ensure_ascii=False)


def test_match_keys_tell_missing_from_empty(spark):
    got = [r[0] for r in run(spark, R.match_keys(F.col("r")))]
    assert got[1] == ["kriterium-B__", "kriterium-A__gewichtung-__"]
    assert got[5] == [""]


def test_field_values_and_views(spark):
    got = run(spark, R.field_values(F.col("r"), "gewichtung"), R.field_view(F.col("r"), "gewichtung"))
    assert got[1] == ([""], [{"gewichtung": ""}, {"gewichtung": ""}])
    assert got[4] == (None, None)


def test_merged_lists(spark):
    df = spark.createDataFrame([(["b", "a", "b"], ["c", "a"])], "x array<string>, y array<string>")
    assert df.select(R.merged_lists(F.col("x"), F.col("y"))).first()[0] == ["a", "b", "c"]
