"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession


def build_session(app: str = "tallymark", master: str | None = None, **settings: str) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps; ``settings`` override."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.sql.session.timeZone": "UTC",
    }
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path for an intermediate table, dropped when the session's JVM ends.

    It lies in the folder of ``spark.checkpoint.dir``, or in the warehouse folder where that is unset: both are shared
    by the driver and all executors. The file system that holds the path deletes it at the end of the session.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/tallymark-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return f"{folder}/{name}"


def written(spark: SparkSession, df, name: str, partition_by: tuple[str, ...] = ()):
    """Cut the lineage of ``df``: write it to the shared folder once and read it back."""
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# A task that writes by partition columns holds so many files open, each with row groups of so many bytes, before it begins to sort.
OPEN_FILES = 32
ROW_GROUP_BYTES = 16 << 20
# A task that writes reads so many bytes at most: a line costs far more to read, score and write than its few bytes suggest, so larger tasks leave
# cores idle while the last ones end.
TASK_BYTES = 32 << 20


@contextmanager
def by_parts(df: DataFrame, parts: tuple[str, ...]) -> Iterator[DataFrameWriter]:
    """A Parquet writer by partition columns that moves no rows: every task writes its own rows, one file a part, held open side by side, so nothing
    is shuffled, and nothing sorted or spilled up to ``OPEN_FILES`` parts a task. A hot part is spread over all tasks by itself."""
    spark = df.sparkSession
    most = min(TASK_BYTES, int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()))
    settings = {"spark.sql.maxConcurrentOutputFileWriters": str(OPEN_FILES), "spark.sql.files.maxPartitionBytes": str(most)}
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        yield df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP_BYTES).partitionBy(*parts)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
