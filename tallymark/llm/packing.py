"""Packing of tokenised documents into sequences: cutting stock by column generation.

A document's ids (its text's, then one end id) are cut into full pieces of the sequence length and one rest. How many
pieces there are of each length is a histogram of at most 1024 numbers, whatever the corpus size. Over it a linear
program chooses how often to use each pattern (a multiset of lengths that fits one sequence); its columns are
generated one at a time from a first-fit basis: the knapsack dynamic program finds the pattern of the greatest worth under the current
prices, and the program ends within ``GAP`` of the lower bound. Pattern counts are rounded down, what is left is packed
first-fit decreasing over the histogram. The driver handles this table of lengths only, never pieces, and only by element-wise
array operations: a threaded matrix library beside the session's JVM can stand still.

Each piece then finds its place by arithmetic: its rank among the pieces of its length (exact, in parts of the id hash, as many as the rows need) tells
which use of which pattern it is, by an equal join on the length with the table of patterns, at most a few thousand rows.

Defined cases: a null or empty text has the end id alone; repeated rows are packed each; null ids are ids of their own; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.llm.words import small_batches
from tallymark.session import written

LENGTH = 1024
END_ID = 0
GAP = 0.001
PIECES, PIECE_ROWS = 256, 1 << 15
_TOKENIZERS: dict = {}


def _default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class TextIds:
    """Ids (little-endian unsigned 32-bit) of a text by the vocabulary of a byte-level tokenizer file.

    The file's vocabulary, in the order of its merges, is handed to the faster of the two libraries that encode it; both give
    the same ids, which a test checks. The texts of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        # Byte-level files write each byte as a printable character: itself if printable, else the next one from 256.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(x): x for x in plain} | {
            chr(256 + k): x for k, x in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte[c] for c in token): k for token, k in vocabulary.items() if all(c in byte for c in token)}
        ranks.pop(b"<|endoftext|>", None)
        self.encoding = tiktoken.Encoding(
            "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> bytes:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, path: str | None = None) -> DataFrame:
    """``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``: the pieces of every document."""
    path = path or _default_path()
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    end = np.array([END_ID], "<u4").tobytes()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TOKENIZERS:
            _TOKENIZERS[path] = TextIds(path)
        tokenizer = _TOKENIZERS[path]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = tokenizer.ids(text.as_py() or "") + end
                total = len(ids) // 4
                for start in range(0, total, length):
                    part = ids[4 * start: 4 * (start + length)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), total))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5,
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return source.mapInArrow(
        task, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def best_pattern(sizes: np.ndarray, prices: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits ``length`` (unbounded knapsack), as counts by size."""
    worth, choice = np.zeros(length + 1), np.full(length + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(length + 1), side="right")
    for room in range(1, length + 1):
        n = fitting[room]
        best = worth[room - 1]
        if n:
            values = worth[room - sizes[:n]] + prices[:n]
            k = values.argmax()
            if values[k] > best + 1e-12:
                best, choice[room] = values[k], k
        worth[room] = best
    counts, room = np.zeros(len(sizes)), length
    while room > 0:
        if choice[room] < 0:
            room -= 1
            continue
        counts[choice[room]] += 1
        room -= sizes[choice[room]]
    return float(worth[length]), counts


def _first_columns(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Fractional first-fit decreasing: each pattern is used until one of its sizes is used up, which gives a basis.

    The last result is the order in which sizes are used up. A pattern holds its own size and later ones only, so in that order
    the basis is lower triangular.
    """
    m = len(sizes)
    columns, used, left, live = np.diag((length // sizes).astype(float)), np.zeros(m), demand.astype(float).copy(), np.ones(m, bool)
    order: list[int] = []
    while live.any():
        room, made = length, np.zeros(m)
        for k in np.flatnonzero(live)[::-1]:
            made[k] = min(np.ceil(left[k]), room // sizes[k])
            room -= int(made[k]) * int(sizes[k])
        share = np.where(made > 0, left / np.maximum(made, 1), np.inf)
        gone = int(share.argmin())
        columns[:, gone], used[gone] = made, share[gone]
        left = np.maximum(left - share[gone] * made, 0)
        live[gone], left[gone] = False, 0
        order.append(gone)
        for k in np.flatnonzero(live & (left <= 1e-9)):  # used up at the same time: its own pattern, not used
            live[k] = False
            order.append(int(k))
    return columns, used, order


def triangular_inverse(matrix: np.ndarray, order: list[int]) -> np.ndarray:
    """The inverse of a matrix that is lower triangular with rows and columns in ``order``, by forward substitution."""
    inverse = np.eye(len(matrix))
    for t, k in enumerate(order):
        inverse[k] /= matrix[k, k]
        for row in order[t + 1:]:
            if matrix[row, k]:
                inverse[row] -= matrix[row, k] * inverse[k]
    return inverse


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, length: int = LENGTH, gap: float = GAP,
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses each, by the revised simplex method.

    It starts from first-fit decreasing patterns. Prices are the dual values; the worth of the best pattern gives a lower bound
    on the number of sequences, as does the total length, and the program goes on until it is within ``gap`` of that bound or no
    pattern is worth more than a sequence. Columns that change nothing, as many in a row as there are sizes, end it too: then
    it stands at a corner where prices no longer improve the plan, which is whole all the same.
    """
    basis, used, order = _first_columns(sizes, demand, length)
    inverse = triangular_inverse(basis, order)
    bound = float((demand * sizes).sum()) / length
    idle = 0
    while used.sum() > (1 + gap) * bound and idle <= len(sizes):
        prices = inverse.sum(axis=0)
        worth, column = best_pattern(sizes, prices, length)
        bound = max(bound, used.sum() / max(worth, 1e-9))
        if worth <= 1 + 1e-9:
            break
        parts = np.flatnonzero(column)
        turn = (inverse[:, parts] * column[parts]).sum(axis=1)
        ratio = np.where(turn > 1e-9, used / np.where(turn > 1e-9, turn, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        idle = idle + 1 if step * (worth - 1) <= 1e-12 * used.sum() else 0
        used = np.maximum(used - step * turn, 0)
        used[out] = step
        pivot = inverse[out] / turn[out]
        inverse -= turn[:, None] * pivot
        inverse[out] = pivot
        basis[:, out] = column
    return basis, used


def patterns_of(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[int, dict[int, int]]]:
    """How often to use which pattern, so that every piece of the histogram has exactly one place."""
    sizes = np.array(sorted(histogram), np.int64)
    left = np.array([histogram[int(s)] for s in sizes], np.int64)
    plan: list[tuple[int, dict[int, int]]] = []
    if not len(sizes):
        return plan
    columns, used = column_generation(sizes, left.astype(float), length)
    for k in np.argsort(-used, kind="stable"):
        column = columns[:, k].astype(np.int64)
        have = column > 0
        times = min(int(used[k] + 1e-6), int((left[have] // column[have]).min()))
        if times > 0:
            plan.append((times, {int(s): int(c) for s, c in zip(sizes[have], column[have])}))
            left = left - times * column
    while left.any():  # first-fit decreasing, as often as the pattern it makes is available
        room, made = length, np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(left)[::-1]:
            made[k] = min(int(left[k]), room // int(sizes[k]))
            room -= made[k] * int(sizes[k])
        have = made > 0
        times = int((left[have] // made[have]).min())
        plan.append((times, {int(s): int(c) for s, c in zip(sizes[have], made[have])}))
        left = left - times * made
    return plan


def packed(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
    path: str | None = None,
) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    small_batches(spark)
    rows = written(spark, pieces(df, id_col, text_col, length, path), "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, sequence, taken = [], 0, {}
    for times, pattern in patterns_of(counts, length):
        offset = 0
        for size, each in sorted(pattern.items(), reverse=True):
            first = taken.get(size, 0)
            table.append((size, first, first + times * each, each, sequence, offset))
            taken[size] = first + times * each
            offset += size * each
        sequence += times
    places = spark.createDataFrame(table, "length long, low long, high long, each long, base long, at long")

    # More pieces for more rows: nearly all rows of a large corpus have the full length.
    pieces_each = max(PIECES, sum(counts.values()) // PIECE_ROWS + 1)
    piece = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(pieces_each))
    dealt = rows.withColumn("_piece", piece)
    before = Window.partitionBy("length").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("length", "_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        "length", "_piece", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_piece").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    ranked = dealt.withColumn("_place", F.row_number().over(inside)).join(sizes, ["length", "_piece"]).withColumn(
        "rank", F.col("_place") - 1 + F.col("_before"))
    placed = ranked.join(F.broadcast(places), "length").where("rank >= low AND rank < high")
    own = F.col("rank") - F.col("low")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("base") + F.floor(own / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + own % F.col("each") * F.col("length")).cast("long").alias("offset"))
