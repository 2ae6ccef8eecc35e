"""Annotated pages as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDS_SCHEMA = T.StructType([
    T.StructField("filename", T.StringType()),
    T.StructField("text_original", T.StringType()),
    T.StructField("text_stripped_empty_spaces", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("context", T.StringType()),
    T.StructField("criteria_info", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
])


# A compressed file is read by one task, so files hold so many pages at most.
FILE_ROWS = 100_000


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Scan annotated pages once, without inferring a schema.

    ``row_idx`` keeps the file order: files sort by name, rows by their place in the file, also when a large file is
    read in several splits.
    """
    df = spark.read.schema(RECORDS_SCHEMA).json(path)
    return df.withColumn(
        "row_idx",
        F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()),
    )


def write_records(df: DataFrame, path: str) -> None:
    """Write annotated pages as compressed lines, in files of ``FILE_ROWS`` pages at most."""
    df.select(*RECORDS_SCHEMA.fieldNames()).write.option("compression", "gzip").option("maxRecordsPerFile", FILE_ROWS).json(path)
