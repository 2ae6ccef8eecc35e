"""From documents to packed sequences: quality, near duplicates, benchmark passages, packing."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import decontaminate, packing, quality, simhash
from tallymark.session import written


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the quality classifier accepts; it learns from ``labels``."""
    return quality.accepted(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each class of near copies: that of the smallest id, then of the least text digest; null ids come last.

    Texts are near copies if the SimHash fingerprints of their three-word shingles differ in two bits at most.
    Rows are told apart by id and text, so a repeated id loses no text; of rows with the same id and text any one stays. Repeats
    are dropped in the map tasks before texts move.
    """
    place, copy = (next(name for k in count() if (name := f"_{what}{k}") not in docs.columns) for what in ("place", "copy"))
    keep = simhash.representatives(spark, docs).toDF(place, copy)
    named = docs.withColumn(place, F.xxhash64("doc_id")).withColumn(copy, simhash.copy_key(F.col("text")))
    return named.dropDuplicates([place, copy]).join(keep, [place, copy], "left_semi").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a test item of ``benchmark``."""
    return decontaminate.without_items(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all kept documents with their sequence and offset."""
    return packing.packed(spark, docs)


STAGES = [
    ("quality", quality_filter), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
