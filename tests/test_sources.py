import json
import os

import pytest
from pyspark.sql import functions as F

from tallymark.operators import prompting, scoring
from tallymark.session import build_session, scratch_path, written
from tallymark.sources import pages, records, results
from tallymark.sources.prompts import PROMPTS, select_prompts

RAW = [
    {"filename": "1_a.txt", "text_original": "ZK1 Preis 40%", "text_stripped_empty_spaces": "ZK1 Preis 40%",
     "label": "has_criteria?", "context": "ZK1 Preis 40%",
     "criteria_info": [{"zkNummer": "1", "kriterium": "Qua-\nlität", "gewichtung": "40%"}]},
    {"filename": "1_b.txt", "text_original": "ZK1 Preis 40%", "label": "has_criteria", "context": "x", "criteria_info": []},
    {"filename": "2_a.txt", "text_original": "y", "label": None, "context": "y", "criteria_info": [{"kriterium": ""}]},
    {"filename": "2_a.txt", "text_original": "z", "label": "has_no_criteria", "context": "z", "criteria_info": []},
]


def test_records_keep_file_order_and_missing_fields(spark, tmp_path):
    path = str(tmp_path / "records.jsonl")
    with open(path, "w", encoding="utf-8") as out:
        out.writelines(json.dumps(r) + "\n" for r in RAW)
    df = records.read_records(spark, path)
    got = df.orderBy("row_idx").collect()
    assert [(r["filename"], r["label"]) for r in got] == [(r["filename"], r["label"]) for r in RAW]
    assert got[0]["criteria_info"] == RAW[0]["criteria_info"] and "maxPunkte" not in got[0]["criteria_info"][0]
    assert got[1]["text_stripped_empty_spaces"] is None and got[2]["criteria_info"] == [{"kriterium": ""}]


def test_pages(spark, tmp_path):
    for name, text in [("12_a_b.txt", "eins\nzwei"), ("13_c, d (e)+_ö%20.txt", "eins\nzwei")]:
        (tmp_path / name).write_text(text, encoding="utf-8")
    got = sorted(map(tuple, pages.read_pages(spark, str(tmp_path), "has_no_criteria").collect()))
    assert got == [("12_a_b.txt", "12", "a_b", "eins\nzwei", "has_no_criteria"),
                   ("13_c, d (e)+_ö%20.txt", "13", "c, d (e)+_ö%20", "eins\nzwei", "has_no_criteria")]


def test_prompts_fan_out_and_render(spark):
    extract = select_prompts("extract")
    assert [p.prompt_id for p in extract] == ["prompt_1", "prompt_2", "prompt_3", "prompt_4"]
    assert [p.prompt_id for p in select_prompts("extract", "prompt_3")] == ["prompt_3"]
    df = spark.createDataFrame([(1, "Seite")], "row_idx int, context string")
    asked = prompting.render(prompting.fan_out(df, extract))
    assert {r["prompt_id"]: r["instruction"] for r in asked.collect()} == {
        p.prompt_id: p.template + "Seite [/INST]" for p in extract}
    assert all(p.template.startswith("[INST] ") for p in PROMPTS)


def test_generation_and_extraction(spark):
    df = spark.createDataFrame([(1, "Preis 40%"), (2, None)], "row_idx int, context string")
    seen = prompting.generate(df, PROMPTS[:2], lambda xs: [str(len(x)) for x in xs]).collect()
    assert {(r["row_idx"], r["prompt_id"], r["answer"]) for r in seen} == {
        (i, p.prompt_id, str(len(p.template + t + " [/INST]"))) for i, t in ((1, "Preis 40%"), (2, "")) for p in PROMPTS[:2]}

    def model(instructions):
        return ["JA, klar" if "Ja oder" in x else "Nichts" if "Namen aller" in x else "[{'zkNummer': 'ZK 7'}]"
                for x in instructions]

    got = {(r["row_idx"], r["prompt_id"]): r for r in prompting.apply_prompts(df, model).collect()}
    assert len(got) == 8
    assert got[1, "prompt_1"]["y_pred"] == [{"zkNummer": "7"}]
    assert got[1, "prompt_3"]["conversion_status"] == "failed" and got[1, "prompt_3"]["y_pred"] is None
    assert {r["label_predicted"] for r in got.values()} == {"has_criteria"}


def scored_rows(spark):
    df = spark.createDataFrame([
        ("a", "has_criteria", "prompt_1", [{"kriterium": "A"}], [{"kriterium": "A"}], "ok"),
        ("b", None, "prompt_1", [], None, "failed"), ("c", "has_no_criteria", "prompt_2", [], None, "failed"),
    ], "filename string, label string, prompt_id string, y_true array<map<string,string>>, "
       "y_pred array<map<string,string>>, conversion_status string")
    return scoring.with_texts(scoring.with_scores(df))


def test_extraction_store_replaces_only_its_parts(spark, tmp_path):
    path, df = str(tmp_path / "run"), scored_rows(spark)
    key = ("filename",)
    df = df.withColumn("context", F.lit("page text"))
    results.write_extraction(df, path, "vendor/m", key)
    results.write_extraction(df.where("prompt_id = 'prompt_1'"), path, "vendor/m", key)
    results.write_extraction(df, path, "other", key)
    stored = results.read_extraction(spark, path)
    assert sorted((r["model"], r["prompt_id"], r["filename"]) for r in stored.collect()) == sorted(
        (m, p, f) for m in ("vendor/m", "other") for f, p in (("a", "prompt_1"), ("b", "prompt_1"), ("c", "prompt_2")))
    views = results.read_extraction(spark, path, "views")
    assert views.where("model = 'other' AND filename = 'a'").count() == 5 and "context" not in views.columns
    row = views.where("model = 'other' AND filename = 'a' AND label_view = 'gewichtung'").first()
    assert row["y_true_as_string"] == "Gewichtung ist . "
    overview = results.read_extraction(spark, path, "overview").where("model = 'other'")
    assert {r["prompt_id"] for r in overview.collect()} == {"prompt_1"} and overview.count() == 5
    plan = stored.where("model = 'other' AND prompt_id = 'prompt_2'").select("key_value_eval.f1_macro")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "f1_macro:double>" in text and "recall" not in text.split("ReadSchema")[1]


def test_sheets(spark, tmp_path):
    path = str(tmp_path / "sheets")
    results.write_sheets({"a": spark.range(3), "b": spark.range(1)}, path)
    results.write_sheets({"a": spark.range(2)}, path)
    assert results.read_sheet(spark, path, "a").count() == 2 and os.path.isdir(f"{path}/b")


def test_classifier_sheets(spark, tmp_path):
    rows = spark.createDataFrame([("validation", "a", "a"), ("validation", "b", "a"), ("test", "a", "a"), ("train", "b", "b")],
                                 "split string, label string, predicted_label string")
    results.write_classifier_run(rows, {"max_iter": 5}, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == [
        "Hyperparameters", "predictions_test_set", "predictions_validation_set", "scores_test_set",
        "scores_validation_and_test_set", "scores_validation_set"]
    both = {r["Metric"]: r for r in results.read_sheet(spark, str(tmp_path), "scores_validation_and_test_set").collect()}
    assert (both["accuracy"]["Validation"], both["accuracy"]["Test"]) == (50.0, 100.0)
    assert results.read_sheet(spark, str(tmp_path), "Hyperparameters").first()["max_iter"] == "5"
    assert results.read_sheet(spark, str(tmp_path), "predictions_validation_set").count() == 2


def test_scratch_folder_comes_from_the_session(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.range(3).withColumn("p", F.lit("x"))
    back = written(spark, df, "t", ("p",))
    assert sorted(map(tuple, back.collect())) == [(0, "x"), (1, "x"), (2, "x")]
    assert scratch_path(spark, "a") != scratch_path(spark, "a")

    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert scratch_path(spark, "name").startswith(f"{shared}/tallymark-")


def test_rows_are_dealt_out_only_where_the_session_says_so(spark, tmp_path):
    from tallymark.plans import inputs

    spark.range(10).coalesce(1).write.parquet(f"{tmp_path}/t.parquet")
    assert inputs.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 1
    spark.conf.set("spark.tallymark.inputPartitions", "3")
    try:
        assert inputs.table(spark, str(tmp_path), "t").rdd.getNumPartitions() == 3
    finally:
        spark.conf.unset("spark.tallymark.inputPartitions")
    assert build_session("again").sparkContext is spark.sparkContext


def test_filters_prune_below_the_exact_parse(spark, tmp_path):
    from tallymark.functions.parse import with_parsed_answer

    rows = spark.createDataFrame([("m", "p1", "[1]"), ("m", "p2", "[{'a': 1}]")], "model string, prompt_id string, answer string")
    rows.write.partitionBy("model", "prompt_id").parquet(f"{tmp_path}/runs")
    parsed = with_parsed_answer(spark.read.parquet(f"{tmp_path}/runs"), "answer").where("prompt_id = 'p2'")
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prompt_id" in plan
    assert plan.count("ArrowEvalPython") == 1
    assert [r["prompt_id"] for r in parsed.collect()] == ["p2"]


def test_presence_fallback_and_factories(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bb"), (3, None)], "row_idx int, context string")
    made = []

    def model():
        made.append(1)
        return lambda xs: ["weiß nicht nnn" if "Ja oder" in x and "bb" in x else "weiß ja" if "Ja oder" in x else "[]" for x in xs]

    found = prompting.apply_prompts(
        df, prompting.PerTask(model), "prompt_1", embed_fn=prompting.PerTask(prompting.stub_encoder), presence_prompt="presence_1")
    assert {r["row_idx"]: r["label_predicted"] for r in found.collect()} == {
        1: "has_criteria", 2: "has_no_criteria", 3: "has_criteria"}
    assert not made  # made in the tasks, not here
    with pytest.raises(ValueError, match="presence prompt"):
        prompting.apply_prompts(df, prompting.stub_generate, presence_prompt="none")


def test_a_run_that_breaks_off_is_never_seen(spark, tmp_path, monkeypatch):
    """The second run breaks between two sheets, a third one between its sheets and the manifest: readers stay with the first."""
    path, df = str(tmp_path / "runs"), scored_rows(spark)
    with pytest.raises(ValueError, match="no whole run"):
        results.published(spark, path, "scored")
    first = results.publish_extraction(df, path, "vendor/m", ("filename",))
    monkeypatch.setattr(results, "with_field_views", lambda d: d.select(F.raise_error(F.lit("broke off")).cast("string").alias("prompt_id"), F.lit("x").alias("label_view"), F.lit(1).alias("v")))
    with pytest.raises(Exception, match="broke off"):
        results.publish_extraction(df.where("filename = 'a'"), path, "vendor/m", ("filename",))
    monkeypatch.undo()
    monkeypatch.setattr(results, "_MANIFEST_ROW", "name string, number long, run long, sheets array<string>")
    with pytest.raises(Exception):
        results.publish_extraction(df.where("filename = 'a'"), path, "vendor/m", ("filename",))
    monkeypatch.undo()
    assert len(os.listdir(f"{path}/{results.RUNS}")) == 3
    assert [(r["name"], r["number"], r["run"]) for r in results.whole_runs(spark, path).collect()] == [("vendor/m", 1, first)]
    assert results.published(spark, path, "scored").count() == 3 and results.published(spark, path, "views").count() == 15


def test_the_newest_whole_run_of_each_name_counts(spark, tmp_path):
    path, df = str(tmp_path / "runs"), scored_rows(spark)
    results.publish_extraction(df, path, "a", ("filename",))
    results.publish_extraction(df.where("filename <> 'c'"), path, "b", ("filename",))
    results.publish_extraction(df.where("filename = 'a'"), path, "a", ("filename",))
    both = results.published(spark, path, "scored")
    assert sorted((r["model"], r["filename"]) for r in both.collect()) == [("a", "a"), ("b", "a"), ("b", "b")]
    assert results.published(spark, path, "views", ["b"]).count() == 10
    assert {r["prompt_id"] for r in results.published(spark, path, "overview", ["a"]).collect()} == {"prompt_1"}
    plan = both.where("prompt_id = 'prompt_1'").select("key_value_eval.f1_macro")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(prompt_id" in plan and "recall" not in plan.split("ReadSchema")[1]
    results.publish(spark, path, "c", {"scored": spark.range(2).select(F.col("id").alias("other"))})
    with pytest.raises(ValueError, match="no whole run"):
        results.published(spark, path, "views", ["c"])
    assert results.published(spark, path, "scored", ["c"]).count() == 2


def _parts_per_file(folder, spark):
    from pyspark.sql.functions import input_file_name

    return [r["n"] for r in spark.read.parquet(folder).groupBy(input_file_name()).agg(F.count_distinct("filename").alias("n")).collect()]


def test_extractions_are_stored_without_a_shuffle(spark, tmp_path):
    """Every task writes its own rows: no file holds rows of two tasks."""
    df = scored_rows(spark).repartitionByRange(3, "filename").withColumn("label", F.lit("has_criteria"))
    assert df.select(F.spark_partition_id()).distinct().count() == 3
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    results.write_extraction(df, f"{tmp_path}/w", "m", ("filename",))
    run = results.publish_extraction(df, f"{tmp_path}/p", "m", ("filename",))
    assert set(_parts_per_file(f"{tmp_path}/w/scored", spark)) == {1}
    assert set(_parts_per_file(f"{tmp_path}/p/{results.RUNS}/{run}/scored", spark)) == {1}
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before


def test_a_published_run_is_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def look(x):
        seen.add(1)
        return x

    df = scored_rows(spark).withColumn("conversion_status", F.udf(look)("conversion_status"))
    results.publish_extraction(df, str(tmp_path), "m", ("filename",))
    assert seen.value == df.count()


def test_records_are_stored_compressed_in_bounded_files(spark, tmp_path, monkeypatch):
    from tallymark.sources import records

    monkeypatch.setattr(records, "FILE_ROWS", 10)
    rows = spark.range(25).coalesce(1).select(
        F.concat("id", F.lit(".txt")).alias("filename"), F.lit("ä\n").alias("text_original"), F.lit(None).cast("string").alias("text_stripped_empty_spaces"),
        F.lit("x").alias("label"), F.repeat(F.lit("text "), 1000).alias("context"), F.expr("array(map('kriterium', 'A'))").alias("criteria_info"))
    records.write_records(rows, f"{tmp_path}/r")
    files = [n for n in os.listdir(f"{tmp_path}/r") if n.startswith("part-")]
    assert len(files) == 3 and sum(os.path.getsize(f"{tmp_path}/r/{n}") for n in files) < 25 * 500
    got = records.read_records(spark, f"{tmp_path}/r").orderBy("row_idx").collect()
    assert [r["filename"] for r in got] == [f"{k}.txt" for k in range(25)] and {r["text_original"] for r in got} == {"ä\n"}


def test_tasks_that_write_by_parts_read_little(spark, tmp_path, monkeypatch):
    """Every file is a task of its own under a small limit; the session's own limit holds where it is smaller, and comes back."""
    from tallymark import session

    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.range(1000).withColumn("p", F.lit("x")).repartition(16).write.parquet(f"{tmp_path}/in")
    monkeypatch.setattr(session, "TASK_BYTES", 1 << 20)
    with session.by_parts(spark.read.parquet(f"{tmp_path}/in"), ("p",)) as writer:
        assert spark.conf.get(key) == str(1 << 20)
        writer.parquet(f"{tmp_path}/out")
    assert len([f for f in os.listdir(f"{tmp_path}/out/p=x") if f.endswith(".parquet")]) == 16
    assert spark.conf.get(key) == before and spark.read.parquet(f"{tmp_path}/out").count() == 1000
    spark.conf.set(key, "1000")
    try:
        with session.by_parts(spark.range(1), ()):
            assert spark.conf.get(key) == "1000"
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.unset(key)
