"""Generation that goes on where an earlier run ended.

Answers are kept by (row, prompt). Rows are dealt into parts by a hash of their key; a run goes through the parts and commits the answers of
each as one write, so a run that is killed loses the part it was at and no more. Before a part is asked, its rows are held
against the answers already stored for it, and only the prompts that lack an answer go to the model: a finished part costs a
look at its keys, new rows or a new prompt cost what is new. Answers that a broken write left half visible are simply
there, since rows are compared and not marks of parts.

Defined cases: the key names a row, and rows that share one count as one; a null key is a key of its own; a null text is an empty one; an
answer may be null and counts as given; without rows nothing is asked.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.operators.prompting import GenerateFn, PerTask, _instructions, _ready
from tallymark.sources.prompts import Prompt

PARTS = 16


def part_of(key: Column, parts: int = PARTS) -> Column:
    """The part of a row, from 0: leading digits of the hash of its key."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 8)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(parts)).cast("int")


def stored_answers(spark: SparkSession, path: str, key_type: T.DataType, key: str = "row_idx") -> DataFrame:
    """``key``, ``prompt_id``, ``answer``, ``part`` of all committed answers; a folder that does not exist yet is empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)
    schema = T.StructType([T.StructField(key, key_type), T.StructField("prompt_id", T.StringType()),
                           T.StructField("answer", T.StringType()), T.StructField("part", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def _same(key: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def open_questions(rows: DataFrame, answers: DataFrame, prompts: Sequence[Prompt], key: str = "row_idx") -> DataFrame:
    """Rows that lack an answer, with ``open``: the prompts they lack it to. Only keys of the stored answers are read; a row has at most one entry
    per prompt."""
    names = F.array(*[F.lit(p.prompt_id) for p in prompts])
    given = answers.groupBy(_same(key).alias("_key")).agg(F.collect_set("prompt_id").alias("_given"))
    asked = rows.withColumn("_key", _same(key)).dropDuplicates(["_key"]).join(given, "_key", "left")
    missing = F.array_except(names, F.coalesce("_given", F.array().cast("array<string>")))
    return asked.withColumn("open", missing).where(F.size("open") > 0).drop("_key", "_given")


def _answers(rows: DataFrame, prompts: Sequence[Prompt], generate_fn: GenerateFn | PerTask, text: str, key: str) -> DataFrame:
    asked = [(p.prompt_id, p.template) for p in prompts]
    out = T.StructType([rows.schema[key], T.StructField("prompt_id", T.StringType()), T.StructField("answer", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ask = _ready(generate_fn)
        for batch in batches:
            open_, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for prompt_id, template in asked:
                places = [k for k, names in enumerate(open_) if prompt_id in names]
                if places:
                    given = list(ask(_instructions(template, [texts[k] for k in places])))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(places)), pa.array([prompt_id] * len(places)), pa.array(given, pa.string())], out.names)

    return rows.select(key, "open", F.col(text).alias("_text")).mapInArrow(run, out)


def generate_on(
    spark: SparkSession, df: DataFrame, prompts: Sequence[Prompt], generate_fn: GenerateFn | PerTask, path: str, key: str = "row_idx",
    text: str = "context", parts: int = PARTS, most_parts: int | None = None,
) -> DataFrame:
    """Ask what is open, part by part, and return all stored answers to ``prompts`` for the rows of ``df``'s folder.

    ``most_parts`` ends the run after so many parts with open questions, for runs of limited time. The number of parts may change between
    runs, since the stored part is only a folder; but then a part's rows are looked up among all answers.
    """
    key_type = df.schema[key].dataType
    asked = 0
    for k in range(parts):
        if most_parts is not None and asked >= most_parts:
            break
        stored = stored_answers(spark, path, key_type, key)
        rows = df.where(part_of(F.col(key), parts) == k)
        known = stored.where((part_of(F.col(key), parts) == k) & F.col("prompt_id").isin([p.prompt_id for p in prompts]))
        missing = open_questions(rows, known, prompts, key)
        if missing.isEmpty():
            continue
        answers = _answers(missing, prompts, generate_fn, text, key).withColumn("part", F.lit(k))
        answers.write.mode("append").partitionBy("part").parquet(path)
        asked += 1
    found = stored_answers(spark, path, key_type, key)
    return found.where(F.col("prompt_id").isin([p.prompt_id for p in prompts])).drop("part")
