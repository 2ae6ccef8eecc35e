"""Product codes of vectors, with distances out of per-dimension value dictionaries.

A component becomes the integer floor(1024 * x). Vectors are cut into equal parts, each with its own codebook of at most 256 entries.
The vectors are laid out once in blocks of some thousand rows: for each dimension the block's distinct integers (its value
dictionary) and each row's place in them. To assign a block, the squared difference of every distinct integer to all entries
is tabulated; the distance of a part to all entries is then a gather of table rows by the codes and a sum over the dimensions of the part,
in integers, so results do not depend on the order of anything. Tasks add up their parts by entry, Spark adds the
tasks, and only the sums (parts x 256 x dimensions of a part) come to the driver for the next codebook.

Defined cases: rows whose vector is null or holds a null, a NaN or an infinity are dropped; a shorter vector is filled with zeros to
the longest one, and all to a multiple of the number of parts; integers are held within +-2**26, so that sums fit; repeated rows and
ids are kept, the first codebook takes them in order of id, then of vector, null ids last; null labels are one group; an empty
table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.operators.skew import salted_lookup
from tallymark.session import written

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 4096
LIMIT = 1 << 26
_CHUNK = 256


def kept_rows(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """``vec_id``, ``v``, ``label_key`` (text; null labels have one of their own) of the rows with a whole vector."""
    vector = F.col(vector_col)
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(vector.isNotNull() & ~odd).select(
        F.col(id_col).alias("vec_id"), vector.cast("array<double>").alias("v"),
        F.coalesce(F.concat(F.lit("="), F.col(label_col).cast("string")), F.lit("")).alias("label_key"))


def _integers(lists: pa.Array, width: int) -> np.ndarray:
    """The rows as integers, filled with zeros to ``width``."""
    flat = np.floor(np.clip(lists.flatten().to_numpy(zero_copy_only=False) * SCALE, -LIMIT, LIMIT)).astype(np.int64)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row per block: its ids and labels, each dimension's sorted distinct integers, and the codes, dimension by dimension."""
    key = f"ids array<{dict(rows.dtypes)['vec_id']}>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                values = _integers(part.column(1), width)
                books, codes = [], np.empty(values.shape[::-1], "<u2")
                for k in range(width):
                    book, codes[k] = np.unique(values[:, k], return_inverse=True)
                    books.append(book)
                yield pa.RecordBatch.from_arrays([
                    *[pa.ListArray.from_arrays([0, part.num_rows], pa.concat_arrays([part.column(k)])) for k in (0, 2)],
                    pa.array([books], pa.list_(pa.list_(pa.int64()))), pa.array([codes.tobytes()], pa.binary()),
                ], ["ids", "label_keys", "books", "codes"])

    return rows.mapInArrow(task, f"{key}, label_keys array<string>, books array<array<bigint>>, codes binary")


def _assigned(books: list, codes: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry and its squared distance for every row and part; the lower index wins a tie."""
    parts, entries, size = codebooks.shape
    rows = codes.shape[1]
    best, error = np.empty((parts, rows), np.int64), np.empty((parts, rows), np.int64)
    for p in range(parts):
        tables = [(books[p * size + j][:, None] - codebooks[p, :, j]) ** 2 for j in range(size)]
        if sum(int(t.max()) for t in tables) < 2**31:
            tables = [t.astype(np.int32) for t in tables]
        for at in range(0, rows, _CHUNK):
            some = codes[p * size: (p + 1) * size, at: at + _CHUNK]
            distance = tables[0][some[0]]
            for table, code in zip(tables[1:], some[1:]):
                distance += table[code]
            nearest = distance.argmin(axis=1)
            best[p, at: at + _CHUNK] = nearest
            error[p, at: at + _CHUNK] = distance[np.arange(len(nearest)), nearest]
    return best, error


def _blocks_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, list, np.ndarray]]:
    for k in range(batch.num_rows):
        lists = batch.column("books")[k].values
        books = [lists[i].values.to_numpy() for i in range(len(lists))]
        yield k, books, np.frombuffer(batch.column("codes")[k].as_buffer(), "<u2").reshape(width, -1)


def _sums(stored: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Per part and used entry: number of rows and sum of their parts."""
    parts, entries, size = codebooks.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, size), np.int64)
        for batch in batches:
            for _, books, codes in _blocks_of(batch, parts * size):
                best, _ = _assigned(books, codes, codebooks)
                for p in range(parts):
                    count[p] += np.bincount(best[p], minlength=entries)
                    for j in range(size):  # sums of a block stay below 2**53
                        k = p * size + j
                        total[p, :, j] += np.bincount(best[p], weights=books[k][codes[k]], minlength=entries).astype(np.int64)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([
            pa.array(p), pa.array(e), pa.array(count[p, e]),
            pa.array(list(total[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"])

    totals = stored.select("books", "codes").mapInArrow(task, "part bigint, entry bigint, n bigint, total array<bigint>")
    return totals.select("part", "entry", "n", F.posexplode("total").alias("at", "x")).groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum("x").alias("x"))


def compressed(
    spark: SparkSession, df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS,
) -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error``, ``codebooks_sha256`` of every kept row; two hexadecimal digits a part."""
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hexadecimal digits: 256 at most")
    rows = kept_rows(df, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    size = max(1, -(-longest // parts))
    # The first codebook: the few smallest ids, `entries` rows at most.
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).toArrow()["v"].combine_chunks()
    start = _integers(first, parts * size).reshape(-1, parts, size) if len(first) else np.zeros((1, parts, size), np.int64)
    codebooks = np.ascontiguousarray(start.transpose(1, 0, 2))
    stored = written(spark, blocks(rows, parts * size), "blocks")
    for _ in range(rounds):
        codebooks = codebooks.copy()
        old = codebooks.copy()
        for r in _sums(stored, old).collect():  # parts x entries x dimensions of a part
            codebooks[r["part"], r["entry"], r["at"]] = r["x"] // r["n"]
    digest = hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, books, codes in _blocks_of(batch, parts * size):
                best, error = _assigned(books, codes, codebooks)
                code = best.T.astype(np.uint8).tobytes().hex()
                texts = [code[i: i + 2 * parts] for i in range(0, len(code), 2 * parts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("ids")[k].values, batch.column("label_keys")[k].values, pa.array(texts, pa.string()),
                    pa.array(error.sum(axis=0))], ["vec_id", "label_key", "code", "error"])

    kind = dict(rows.dtypes)["vec_id"]
    coded = written(spark, stored.mapInArrow(task, f"vec_id {kind}, label_key string, code string, error bigint"), "codes")
    labels = coded.groupBy("label_key").agg(F.sum("error").alias("label_error"))
    return salted_lookup(coded, labels, "label_key", "vec_id", "inner").select(
        "vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
