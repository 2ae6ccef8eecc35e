"""The page folder source: reading by name, writing by name, and runs that end early."""

import os

import pytest
from pyspark.sql import functions as F

from tallymark.sources import pages

PAGES = {"12_a.txt": "eins", "12_b_c.txt": "zwei\nDrei ä€", "13_a.txt": "", "x.txt": "kein Teil", "99_ü +%.txt": "\r\nend\n"}


def stored(spark, tmp_path, rows=None, name="p", mode="append"):
    rows = list(PAGES.items()) if rows is None else rows
    df = spark.createDataFrame(rows, "filename string, text string").withColumn("label", F.lit("other"))
    pages.write_page_folder(df, f"{tmp_path}/{name}", mode)
    return f"{tmp_path}/{name}"


def as_rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_pages_come_back_as_they_were(spark, tmp_path):
    path = stored(spark, tmp_path)
    assert sorted(os.listdir(path)) == sorted(PAGES)
    got = {r["filename"]: r for r in pages.page_folder(spark, path, "k").collect()}
    assert {n: r["text"] for n, r in got.items()} == PAGES and {r["label"] for r in got.values()} == {"k"}
    assert (got["12_b_c.txt"]["tender_id"], got["12_b_c.txt"]["document"]) == ("12", "b_c")
    assert (got["x.txt"]["tender_id"], got["x.txt"]["document"]) == ("", "")
    assert as_rows(pages.page_folder(spark, f"file:{path}").select("filename", "text")) == sorted(PAGES.items())
    # The same pages through Spark's text reader.
    columns = ("filename", "tender_id", "document", "text", "label")
    theirs = as_rows(pages.read_pages(spark, path, "k").select(*columns))
    assert [r for r in theirs if r[3]] == [r for r in as_rows(pages.page_folder(spark, path, "k").select(*columns)) if r[3]]


def test_filters_on_names_open_no_other_files(spark, tmp_path):
    path = stored(spark, tmp_path)
    with open(f"{path}/14_locked.txt", "w") as file:
        file.write("x")
    os.chmod(f"{path}/14_locked.txt", 0)
    df = pages.page_folder(spark, path)
    asked = {
        "tender_id = '12'": {"12_a.txt", "12_b_c.txt"}, "filename IN ('x.txt', '13_a.txt', 'none')": {"x.txt", "13_a.txt"},
        "tender_id LIKE '1%' AND document LIKE '%a'": {"12_a.txt", "13_a.txt"}, "document LIKE '%_c%' AND text LIKE 'z%'": {"12_b_c.txt"},
        "tender_id = '77'": set(), "filename LIKE '%.txt' AND tender_id = '12' AND length(text) = 4": {"12_a.txt"},
    }
    for condition, names in asked.items():
        assert {r["filename"] for r in df.where(condition).collect()} == names, condition
    reader = pages.PageReader({"path": path})
    kept = list(reader.pushFilters([pages.EqualTo(("tender_id",), "12"), pages.EqualTo(("text",), "eins"), pages.EqualTo(("a", "b"), 1)]))
    assert len(kept) == 2 and [p.names for p in reader.partitions()] == [["12_a.txt", "12_b_c.txt"]]


def test_partitions_hold_files_up_to_a_size(spark, tmp_path):
    path = stored(spark, tmp_path, [(f"{k}_p.txt", "x" * 100 * k) for k in range(1, 8)])
    reader = pages.PageReader({"path": path, "partitionBytes": "600"})
    assert [len(p.names) for p in reader.partitions()] == [3, 1, 1, 1, 1]
    df = pages.page_folder(spark, path, partition_bytes=600)
    assert df.rdd.getNumPartitions() == 5 and df.agg(F.sum(F.length("text"))).first()[0] == 2800


def test_append_and_overwrite(spark, tmp_path):
    path = stored(spark, tmp_path, [("1_a.txt", "old"), ("2_a.txt", "stays")])
    stored(spark, tmp_path, [("1_a.txt", "new"), ("3_a.txt", None)])
    assert as_rows(pages.page_folder(spark, path).select("filename", "text")) == [("1_a.txt", "new"), ("2_a.txt", "stays"), ("3_a.txt", "")]
    stored(spark, tmp_path, [("9_a.txt", "only")], mode="overwrite")
    assert as_rows(pages.page_folder(spark, path).select("filename", "text")) == [("9_a.txt", "only")]
    assert os.listdir(path) == ["9_a.txt"]


@pytest.mark.parametrize("rows", [[("1_a.txt", "x"), ("1_a.txt", "y")], [("../1.txt", "x")], [(None, "x")], [(".x", "x")]])
def test_runs_that_end_early_leave_what_was_there(spark, tmp_path, rows):
    path = stored(spark, tmp_path, [("1_a.txt", "old")])
    with pytest.raises(Exception):
        stored(spark, tmp_path, rows + [("5_a.txt", "z")], mode="overwrite")
    assert as_rows(pages.page_folder(spark, path).select("filename", "text")) == [("1_a.txt", "old")]
    assert os.listdir(path) == ["1_a.txt"]


def test_empty_folders(spark, tmp_path):
    path = stored(spark, tmp_path, [])
    os.makedirs(path, exist_ok=True)
    assert pages.page_folder(spark, path).count() == 0
