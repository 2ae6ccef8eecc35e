"""Generation that goes on: a killed run, new rows, new prompts."""

import os

import pytest
from pyspark.sql import functions as F

from tallymark.operators import resume
from tallymark.sources.prompts import PROMPTS

ASKED = PROMPTS[:2]


def model(folder, run, breaks=False):
    """Answers with the run's name, notes each instruction in a file of the run, and breaks down on a marked text."""
    folder = str(folder)

    def ask(instructions):
        with open(f"{folder}/{run}-{os.getpid()}", "a") as file:
            file.writelines("x\n" for _ in instructions)
        if breaks and any("BREAK" in x for x in instructions):
            raise RuntimeError("the model broke down")
        return [run if "null" not in x else None for x in instructions]

    return ask


def calls(folder, run):
    return sum(len(open(f"{folder}/{n}").readlines()) for n in os.listdir(folder) if n.startswith(f"{run}-"))


def frame(spark, n):
    return spark.createDataFrame([(k, f"text {k}") for k in range(n)], "row_idx long, context string").withColumn("part", F.lit("x")).withColumn("open", F.lit(1))


def test_a_killed_run_goes_on(spark, tmp_path):
    """The run breaks down in its fifth part of eight: four are there, and only the other half is asked again."""
    notes, path = tmp_path / "notes", str(tmp_path / "answers")
    notes.mkdir()
    df = frame(spark, 80).withColumn("_part", resume.part_of(F.col("row_idx"), 8))
    df = df.withColumn("context", F.when(F.col("_part") >= 4, F.lit("BREAK")).otherwise(F.col("context")))
    early = df.where("_part < 4").count()
    with pytest.raises(Exception, match="broke down"):
        resume.generate_on(spark, df, ASKED, model(notes, "first", True), path, parts=8)
    assert resume.stored_answers(spark, path, df.schema["row_idx"].dataType).count() == 2 * early
    found = resume.generate_on(spark, df, ASKED, model(notes, "second"), path, parts=8).collect()
    assert len(found) == 160 and len({(r["row_idx"], r["prompt_id"]) for r in found}) == 160
    assert sum(r["answer"] == "first" for r in found) == 2 * early and calls(notes, "second") == 2 * (80 - early)
    resume.generate_on(spark, df, ASKED, model(notes, "third"), path, parts=8)
    assert calls(notes, "third") == 0


def test_new_rows_and_prompts_cost_what_is_new(spark, tmp_path):
    notes, path = tmp_path / "notes", str(tmp_path / "answers")
    notes.mkdir()
    resume.generate_on(spark, frame(spark, 10), ASKED, model(notes, "a"), path, parts=2)
    resume.generate_on(spark, frame(spark, 13), PROMPTS[:3], model(notes, "b"), path, parts=2)
    assert (calls(notes, "a"), calls(notes, "b")) == (20, 10 + 3 * 3)
    # Another number of parts finds the stored answers all the same.
    found = resume.generate_on(spark, frame(spark, 13), PROMPTS[:3], model(notes, "c"), path, parts=5)
    assert calls(notes, "c") == 0 and found.count() == 39


def test_resume_cases(spark, tmp_path):
    notes, path = tmp_path / "notes", str(tmp_path / "answers")
    notes.mkdir()
    rows = [(None, "a"), (1, None), (2, "null"), (2, "null"), (3, "b")]
    df = spark.createDataFrame(rows, "row_idx long, context string")
    assert resume.generate_on(spark, df.where("false"), ASKED, model(notes, "e"), path).count() == 0
    for run in ("f", "g"):
        found = resume.generate_on(spark, df, ASKED, model(notes, run), path, parts=3).collect()
        assert len(found) == 8 and {(r["row_idx"], r["answer"]) for r in found} == {(None, "f"), (1, "f"), (2, None), (3, "f")}
    assert calls(notes, "g") == 0 and calls(notes, "f") == 8


def test_marked_model_travels_after_other_queries(spark):
    """The parser's Python step holds a handle of the session once it has been used; the model of the second run must not take it along."""
    from pyspark import cloudpickle

    from tallymark.functions.parse import with_parsed_answer
    from tallymark.plans import catalog

    with_parsed_answer(spark.createDataFrame([("[{'a': 'b' 'c'}]",)], "pred_output_as_string string")).collect()
    sent = cloudpickle.loads(cloudpickle.dumps(catalog._marked_stub))
    text = f"{PROMPTS[0].template}page [/INST]"
    assert sent([text]) == [f"2: {answer}" for answer in catalog.stub_generate([text])]
