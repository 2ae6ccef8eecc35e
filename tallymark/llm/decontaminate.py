"""Benchmark decontamination: size-partitioned MinHash search for test items inside documents.

Texts are compared by five-word shingles; words are runs of letters, digits and characters beyond ASCII, in lower case, so
punctuation and case do not matter. A short item inside a long document has a tiny Jaccard similarity to it, so documents are not
signed as a whole. Items are partitioned by size (their number of shingles, in powers of two), and for each size s in
use a document is covered by overlapping windows of 2s shingles in steps of s: an item that stands in the document
stands in one window of similar size. The least values of 64 universal hash functions over each window are looked up among the
items' own (bands of one row: the similarity is 0.19 or more, so a contained item is missed with a probability of 1.4e-6). Candidates are verified
exactly: containment is the share of the item's distinct shingles that the whole document has, word for word.

The items are a stated query set. They are handled in blocks of at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` of text, each broadcast
to one pass over the documents; no document moves, and a document found by several items gives one row for each.

Defined cases: null and empty texts have no words and match nothing; an item or document of one to four words has its
whole word sequence as its one shingle, so it only matches the same sequence; repeated items and documents give a row each
pair; an item of several sizes does not exist; an empty table on either side gives no rows; other columns are not read (or passed on
unchanged by ``without_items``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.minhash import multipliers
from tallymark.llm.words import LETTERED, Words, shingle_hashes, slices, small_batches

SHINGLE = 5
HASHES = 64
THRESHOLD = 0.8
BLOCK_ITEMS = 32_768
BLOCK_BYTES = 32 << 20
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_TOP = np.uint32(0xFFFFFFFF)
_LOW = np.uint32(0xFFFF)


def _normal(text: str) -> tuple[list[bytes], bytes]:
    words = _WORD.findall(text.lower().encode())
    return words, b" " + b" ".join(words) + b" "


class Items:
    """One block of test items: their shingles, and by size class and hash function the values to look for."""

    def __init__(self, rows: list[tuple], threshold: float = THRESHOLD):
        self.threshold, self.ids, self.shingles, self.short = threshold, [], [], []
        self.tables: dict[int, list[tuple]] = {}
        found: dict[int, list[list[tuple[int, int]]]] = {}
        a, b = multipliers(HASHES)
        for item, text in rows:
            words, normal = _normal(text or "")
            if not words:
                continue
            runs = {b" " + b" ".join(words[k: k + SHINGLE]) + b" " for k in range(max(1, len(words) - SHINGLE + 1))}
            place = len(self.ids)
            self.ids.append(item)
            self.shingles.append(sorted(runs))
            self.short.append(normal if len(words) < SHINGLE else None)
            size = 1 << (len(runs) - 1).bit_length()
            batch = Words(pc.utf8_lower(pa.array([text])), LETTERED)
            values = (shingle_hashes(batch.hashes(), batch.first, SHINGLE)[0] >> np.uint64(32)).astype(np.uint32)
            for k, least in enumerate((a * values + b).min(axis=1)):
                found.setdefault(size, [[] for _ in range(HASHES)])[k].append((int(least), place))
        for size in sorted(found):
            self.tables[size] = []
            for pairs in found[size]:
                pairs.sort()
                values = np.array([v for v, _ in pairs], np.uint32)
                known = np.zeros(1 << 16, bool)
                known[values & _LOW] = True
                self.tables[size].append((known, values, np.array([p for _, p in pairs])))

    def candidates(self, texts: pa.Array) -> set[tuple[int, int]]:
        """Pairs (row, item place) with a window whose signature agrees with the item's somewhere."""
        batch = Words(pc.utf8_lower(texts), LETTERED)
        hashes, bounds = shingle_hashes(batch.hashes(), batch.first, SHINGLE)
        out: set[tuple[int, int]] = set()
        if not len(hashes) or not self.tables:
            return out
        # Every text starts at a multiple of the largest size, so blocks of all sizes lie inside one text.
        largest = max(self.tables)
        counts = np.diff(bounds)
        blocks = -(-counts // largest)
        total = int(blocks.sum()) * largest
        base = (np.cumsum(blocks) - blocks) * largest
        at = np.arange(len(hashes)) + np.repeat(base - bounds[:-1], counts)
        values = np.zeros(total, np.uint32)
        values[at] = (hashes >> np.uint64(32)).astype(np.uint32)
        empty = np.ones(total, bool)
        empty[at] = False
        empty = np.flatnonzero(empty)
        owner = np.repeat(np.arange(len(counts)), blocks)
        a, b = multipliers(HASHES)
        for k in range(HASHES):
            least = values * a[k, 0] + b[k, 0]
            least[empty] = _TOP
            size = 1
            while size <= largest:
                if size in self.tables:
                    self._look(k, size, least, np.minimum(least[:-1], least[1:]), owner, largest // size, out)
                if size < largest:
                    least = np.minimum(least[0::2], least[1::2])
                size *= 2
        return out

    def _look(self, k, size, single, double, owner, per_owner, out) -> None:
        known, values, places = self.tables[size][k]
        for windows in (double, single):
            hits = np.flatnonzero(known[windows & _LOW])
            hits = hits[windows[hits] != _TOP]
            left, right = np.searchsorted(values, windows[hits], "left"), np.searchsorted(values, windows[hits], "right")
            for hit, low, high in zip(hits[left < right], left[left < right], right[left < right]):
                # A window over two texts may name the wrong one; both are candidates and are verified.
                rows = {int(owner[hit // per_owner]), int(owner[min(hit + 1, len(single) - 1) // per_owner])}
                out.update((row, int(places[p])) for row in rows for p in range(low, high))

    def matches(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
        """(row, item place, shared, size) of each text that contains an item, whole texts compared."""
        for start, stop in slices(texts):
            part = pc.fill_null(texts[start:stop], "")
            row, words, normal = -1, [], b""
            for at, place in sorted(self.candidates(part)):
                if at != row:
                    row, (words, normal) = at, _normal(part[at].as_py())
                if self.short[place] is not None:
                    shared = int(normal == self.short[place])
                elif len(words) < SHINGLE:
                    shared = 0
                else:
                    shared = sum(s in normal for s in self.shingles[place])
                if shared >= self.threshold * len(self.shingles[place]) and shared:
                    yield start + at, place, shared, len(self.shingles[place])


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    """The items in blocks of bounded number and size."""
    small_batches(items.sparkSession)
    narrow = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, size = narrow.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // (BLOCK_ITEMS // 2)), -(-size // (BLOCK_BYTES // 2)))  # half full on average
    for block in range(blocks):
        yield [tuple(r) for r in narrow.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).collect()]


def contaminated(
    spark: SparkSession, df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``containment``, ``shared``, ``item_shingles`` for every item found in a document."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kinds = dict(source.dtypes)["doc_id"], dict(items.dtypes)[item_id]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, containment double, shared bigint, item_shingles bigint"
    found = spark.createDataFrame([], schema)
    for rows in _blocks(items, item_id, item_text):
        block = spark.sparkContext.broadcast(Items(rows, threshold))

        def task(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                hits = list(block.value.matches(batch.column(1)))
                if hits:
                    rows, places, shared, sizes = zip(*hits)
                    share = np.array(shared) / np.array(sizes)
                    item_type = pa.array([block.value.ids[0]]).type
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(rows)), pa.array([block.value.ids[p] for p in places], item_type),
                        pa.array(share), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64()),
                    ], ["doc_id", "item_id", "containment", "shared", "item_shingles"])

        found = found.union(source.mapInArrow(task, schema))
    return found


def without_items(
    spark: SparkSession, df: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text contains none of the items. Nothing is shuffled."""
    place = df.columns.index(text_col)
    for rows in _blocks(items, item_id, item_text):
        block = spark.sparkContext.broadcast(Items(rows, threshold))

        def task(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[row for row, *_ in block.value.matches(batch.column(place))]] = False
                yield batch.filter(pa.array(keep))

        df = df.mapInArrow(task, df.schema)
    return df
