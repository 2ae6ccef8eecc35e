"""Page files named ``<tender id>_<document>.txt``.

``read_pages`` scans a folder with Spark's text reader. ``PageFolder`` is a data source of its own, for reading and writing: it gives a file
to each row by the row's name, which Spark's writers cannot, and looks at names before it opens files.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, StringContains, StringEndsWith,
    StringStartsWith, WriterCommitMessage,
)

# The shape of a page file name.
PAGE_NAME = r"^(\d+)_(.*)\.txt$"


def tender_id(name: Column) -> Column:
    return F.regexp_extract(name, PAGE_NAME, 1)


def document_name(name: Column) -> Column:
    return F.regexp_extract(name, PAGE_NAME, 2)


def read_pages(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """One row per file with its whole text; ``label`` is a class that holds for the whole folder."""
    df = spark.read.text(path, wholetext=True)
    # Spark gives file names as they stand in a URI: percent signs decode, a plus is a plus.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select(
        name.alias("filename"), tender_id(name).alias("tender_id"), document_name(name).alias("document"),
        F.col("value").alias("text"), F.lit(label).cast("string").alias("label"),
    )


PAGE_FOLDER = "page_folder"
PARTITION_BYTES = 16 << 20
BATCH_FILES = 256
_PAGE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("filename", "tender_id", "document", "text", "label")])
_NAME = re.compile(PAGE_NAME, re.DOTALL)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder: a plain path, ``file:`` in any form, or another store that pyarrow can reach."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), path.rstrip("/")) if "://" not in path else pafs.FileSystem.from_uri(path.rstrip("/"))


def _name_parts(name: str) -> dict[str, str]:
    found = _NAME.match(name)
    return {"filename": name, "tender_id": found.group(1) if found else "", "document": found.group(2) if found else ""}


@dataclass
class PageFiles(InputPartition):
    """Files that one task reads."""

    names: list[str]

    def __init__(self, names: list[str]):
        super().__init__(names)
        self.names = names


class PageReader(DataSourceReader):
    """Lists the folder once. Filters on the name and its two parts are answered from the list, so other files are never opened; the others are
    dealt into partitions of ``partitionBytes`` at most, one file at least."""

    def __init__(self, options: dict):
        self.path, self.label = options["path"], options.get("label")
        self.bytes = int(options.get("partitionBytes", PARTITION_BYTES))
        self.wanted: list[tuple] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        tests = {EqualTo: "is", In: "in", StringStartsWith: "starts", StringEndsWith: "ends", StringContains: "contains", IsNotNull: "known"}
        for f in filters:
            if type(f) in tests and len(f.attribute) == 1 and f.attribute[0] in ("filename", "tender_id", "document"):
                self.wanted.append((tests[type(f)], f.attribute[0], getattr(f, "value", None)))
            else:
                yield f

    def _fits(self, name: str) -> bool:
        parts = _name_parts(name)
        test = {
            "is": lambda x, v: x == v, "in": lambda x, v: x in v, "starts": lambda x, v: x.startswith(v), "ends": lambda x, v: x.endswith(v),
            "contains": lambda x, v: v in x, "known": lambda x, v: True,
        }
        return all(test[kind](parts[column], value) for kind, column, value in self.wanted)

    def partitions(self) -> list[PageFiles]:
        files, folder = _place(self.path)
        found = [(f.base_name, f.size or 0) for f in files.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File]
        out, size = [], 0
        for name, n in sorted(found):
            if name.startswith((".", "_")) or not self._fits(name):
                continue
            if not out or size + n > self.bytes:
                out.append([])
                size = 0
            out[-1].append(name)
            size += n
        return [PageFiles(names) for names in out or [[]]]  # no partition at all is not allowed

    def read(self, partition: PageFiles) -> Iterator[pa.RecordBatch]:
        files, folder = _place(self.path)
        held: list[tuple] = []
        size = 0
        for name in partition.names:
            with files.open_input_stream(f"{folder}/{name}") as file:
                text = file.read().decode("utf-8", "replace")
            held.append((*_name_parts(name).values(), text, self.label))
            size += len(text)
            if len(held) == BATCH_FILES or size >= PARTITION_BYTES:
                yield _batch(held)
                held, size = [], 0
        if held:
            yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], _PAGE_SCHEMA.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class PageWriter(DataSourceArrowWriter):
    """Tasks write into a hidden folder of the run; only when all have ended are the files moved to their names. A name that occurs twice ends the
    run before anything is moved, and a run that ends early leaves nothing behind but what was there before."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.hidden = f".run-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, folder = _place(self.path)
        stage, names = f"{folder}/{self.hidden}/{uuid.uuid4().hex}", []  # a repeated task writes into a folder of its own
        files.create_dir(stage, recursive=True)
        for batch in iterator:
            for name, text in zip(batch.column("filename").to_pylist(), batch.column("text").to_pylist()):
                if not name or "/" in name or name.startswith((".", "_")):
                    raise ValueError(f"not a page file name: {name!r}")
                with files.open_output_stream(f"{stage}/{name}") as file:
                    file.write((text or "").encode())
                names.append(f"{stage}/{name}")
        return Written(names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _place(self.path)
        staged = [name for m in messages if m is not None for name in m.names]
        twice = [name for name, n in Counter(s.rsplit("/", 1)[1] for s in staged).items() if n > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"two pages are named {sorted(twice)[0]!r}")
        if self.overwrite:
            old = files.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            for f in old:
                if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")):
                    files.delete_file(f.path)
        for s in staged:
            files.move(s, f"{folder}/{s.rsplit('/', 1)[1]}")
        self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, folder = _place(self.path)
        if files.get_file_info(f"{folder}/{self.hidden}").type == pafs.FileType.Directory:
            files.delete_dir(f"{folder}/{self.hidden}")


class PageFolder(DataSource):
    """``spark.read.format("page_folder").option("label", ...).load(folder)`` and ``df.write.format("page_folder").save(folder)``.

    Rows have ``filename``, ``tender_id``, ``document``, ``text`` and ``label``, a class that holds for the folder. What is written needs
    ``filename`` and ``text``; a null text is an empty file. Files whose names begin with a dot or an underscore are none of the pages.
    """

    @classmethod
    def name(cls) -> str:
        return PAGE_FOLDER

    def schema(self) -> T.StructType:
        return _PAGE_SCHEMA

    def reader(self, schema: T.StructType) -> PageReader:
        return PageReader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> PageWriter:
        return PageWriter(self.options, overwrite)


def page_folder(spark: SparkSession, path: str, label: str | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """The pages of a folder; filters on their names reach the listing."""
    spark.dataSource.register(PageFolder)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format(PAGE_FOLDER).option("partitionBytes", str(partition_bytes))
    return (reader.option("label", label) if label is not None else reader).load(path)


def write_page_folder(df: DataFrame, path: str, mode: str = "append") -> None:
    """One file per row, named by ``filename``. ``overwrite`` drops the pages that were there, once the new ones are written."""
    df.sparkSession.dataSource.register(PageFolder)
    df.select("filename", "text").write.format(PAGE_FOLDER).mode(mode).save(path)
