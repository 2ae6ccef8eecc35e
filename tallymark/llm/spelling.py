"""Groups of spelling variants: words one edit apart, found by a frontier of states in a trie that lies in Spark tables.

Words are maximal runs of Latin letters with A-Z in lower case, counted over all documents. Each word goes through a trie
twice, from its front and from its back. An edit lies in the second half of a word or in the first; the front walk looks for
edits behind the first half, the back walk for the others, so no walk branches where the trie is dense.

The trie keeps the places where words part or end and where a half ends; an edge carries the letters between two of them. A state is
(word, position, node, edits). The states without an edit are the places on a word's own way, which the trie gives; joined with the edge
table they make the one edit: an edge whose letters stand in the word but for one replaced letter or one left out. A state
is kept if its word's next letter begins an edge of its node, or if both its word and a word of the trie end there. These
states are then joined with the edge table level by level, and now the letters must stand there as they are. A state at the end of its
word and at the end of a word of the trie is a neighbour. Only the longer word of a pair, or the smaller of two of one
length, looks for the other: the pair is then entered both ways. Nodes are 64-bit hashes of prefixes, so two prefixes might
share one; each hit is therefore compared as text, and what a shared hash adds falls out there.

A node on the way of more than 1/256 of all words is dealt over salts, with a copy of its edges (at most one per letter) for each. With
one edit a state asks for one letter of a node; what still meets there is split by the skew join. The number of levels is
that of the partings along a word, not of its letters, so long words need no more levels.

Defined cases: null and empty texts have no words; a null id writes as nothing before the colon of the edit rule; repeated rows count
each; of neighbours with equal counts the first in code-point order is the form; an empty table gives an empty table; other
columns are not read; a word of any length is whole.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.words import mix, powers, slices, small_batches
from tallymark.operators.skew import HOT_SHARE, salted_lookup
from tallymark.session import written

MIN_LENGTH = 5
MIN_COUNT = 3
FACTOR = 2
DAMAGE = 97
HELD_WORDS = 200_000
HELD_LETTERS = 8 << 20
_PART = 1 << 20
_AT_ONCE = 1 << 15
_SHORT = 64
_RUN = re.compile("[a-zÀ-ÿ]+")
_GAP = re.compile("[^a-zÀ-ÿ]")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_CRC = np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)  # what a register's low byte becomes


def _parts(text: str) -> Iterator[str]:
    """A lower-cased text; a long one in parts that end between runs."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + _PART) if len(text) - at > _PART else None
        end = gap.start() if gap else len(text)
        yield text[at:end] if end - at < len(text) else text
        at = end


def runs(text: str) -> Iterator[str]:
    """The runs of letters of a lower-cased text; a long text is read in parts that end between runs."""
    for part in _parts(text):
        yield from _RUN.findall(part)


def damaged(start: int, run: str, every: int = DAMAGE) -> str:
    """The run without one letter if the checksum says so; ``start`` is the checksum of the id and a colon."""
    h = zlib.crc32(run.encode(), start)
    if h % every:
        return run
    k = h % len(run)
    return run[:k] + run[k + 1:]


class _Held(defaultdict):
    """Words with a place each, in the order of their places, and how often they occurred.

    A checksum is linear: that of an id, a colon and a run is the run's own, xor what the id's becomes by as many zero bytes. So a run's
    checksum is made once for each word held, and all occurrences are looked at together.
    """

    def __init__(self):
        super().__init__(count().__next__)
        self.letters, self.counts = 0, np.zeros(0, np.int64)
        self.sums, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _grow(self) -> list[str]:
        words = list(self)
        new = words[len(self.sums):]
        self.letters += sum(map(len, new))
        new = [w.encode() for w in new]
        self.sums = np.append(self.sums, np.fromiter(map(zlib.crc32, new), np.uint32, len(new)))
        self.sizes = np.append(self.sizes, np.fromiter(map(len, new), np.int64, len(new)))
        self.counts = np.append(self.counts, np.zeros(len(new), np.int64))
        return words

    def add(self, places: array, starts: array, ends: array, every: int) -> None:
        """Count occurrences; ``starts``: checksum of the id and a colon, of the occurrences before ``ends``."""
        if not len(places):
            return
        words = self._grow()
        ids = np.frombuffer(places, np.int64)
        starts = np.array(starts, np.uint32)
        of = np.repeat(np.arange(len(starts)), np.diff(np.array(ends), prepend=0))
        sizes = self.sizes[ids]
        after = [starts]
        for _ in range(min(int(sizes.max()), _SHORT)):
            after.append(_CRC[after[-1] & np.uint32(255)] ^ (after[-1] >> np.uint32(8)))
        h = self.sums[ids] ^ np.stack(after)[np.minimum(sizes, _SHORT), of]
        asked = np.flatnonzero((h % np.uint32(every) == 0) | (sizes > _SHORT))  # these one by one
        self.counts += np.bincount(ids, minlength=len(self)) - np.bincount(ids[asked], minlength=len(self))
        if len(asked):
            back = [self[damaged(start, words[k], every)] for k, start in zip(ids[asked].tolist(), starts[of[asked]].tolist())]
            self._grow()
            self.counts += np.bincount(back, minlength=len(self))

    def rows(self, min_length: int) -> pa.RecordBatch:
        words = pa.array(self.keys(), pa.string())
        kept = pa.RecordBatch.from_arrays([words, pa.array(self.counts)], ["word", "n"])
        return kept.filter(pc.and_(pc.greater_equal(pc.utf8_length(words), min_length), pc.greater(kept.column(1), 0)))


def word_counts(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, damage: int = DAMAGE,
) -> DataFrame:
    """``word``, ``n``. A task holds about ``HELD_WORDS`` words or ``HELD_LETTERS`` letters of them at most; what it hands on is summed by Spark."""
    small_batches(spark)
    source = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    find = re.compile(f"[a-zÀ-ÿ]{{{max(min_length, 1)},}}").findall  # an edit makes no run longer

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, starts, ends, read = _Held(), array("q"), array("L"), array("q"), 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for part in _parts(text.as_buffer().to_pybytes().translate(_LOWER).decode()):
                    ids.extend(map(held.__getitem__, find(part)))
                    starts.append(start)
                    ends.append(len(ids))
                    read += len(part)
                    if read >= _PART or len(starts) >= _AT_ONCE or len(held) >= HELD_WORDS:
                        held.add(ids, starts, ends, damage)
                        ids, starts, ends, read = array("q"), array("L"), array("q"), 0
                        if len(held) >= HELD_WORDS or held.letters >= HELD_LETTERS:
                            yield held.rows(min_length)
                            held = _Held()
        held.add(ids, starts, ends, damage)
        yield held.rows(min_length)

    counts = source.mapInArrow(task, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All prefixes from the half on: node, depth, next letter (0 at the end of the word)."""
    for batch in batches:
        for start, stop in slices(batch.column(2)):
            some = batch.slice(start, stop - start)
            tids, back, half = (some.column(k).to_numpy() for k in (0, 1, 3))
            letters = np.frombuffer("".join(some.column(2).to_pylist()).encode("utf-32-le"), np.uint32).astype(np.uint64)
            sizes = pc.utf8_length(some.column(2)).to_numpy().astype(np.int64)
            first = np.cumsum(sizes) - sizes
            up, down = powers(len(letters) + 1)
            sums = np.concatenate([[np.uint64(0)], np.cumsum((letters + np.uint64(1)) * up[: len(letters)])])
            count = sizes - half + 1
            of = np.repeat(np.arange(len(sizes)), count)
            depth = half[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            at = first[of] + depth
            hashes = mix(mix((sums[at] - sums[first[of]]) * down[first[of]]) + back[of].astype(np.uint64)).view(np.int64)
            following = np.where(depth < sizes[of], np.append(letters, [np.uint64(0)])[at], np.uint64(0)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (tids[of], hashes, depth, following, depth == half[of])], ["tid", "node", "depth", "next", "half"])


def trie(spark: SparkSession, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The walks (``tid``, ``back``, ``text``, ``n``, ``half``, ``path``), the edges (``node``, ``child``, ``label``, ``ends``, ``low``,
    ``high``: least and greatest number of letters from the child to the end of a word, ``nexts``: the first letters of the child's own
    edges) and the hot nodes.
    """
    m = F.length("word")
    both = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("back")).select(
        F.monotonically_increasing_id().alias("tid"), "back", "n",
        F.when(F.col("back") == 0, F.col("word")).otherwise(F.reverse("word")).alias("text"),
        F.when(F.col("back") == 0, F.floor(m / 2)).otherwise(m - F.floor(m / 2)).cast("int").alias("half"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    walks = written(spark, both.repartition(tasks), "walks")  # short rows in few files: without it, a few tasks would make all prefixes
    rows = written(spark, walks.select("tid", "back", "text", "half").mapInArrow(
        _prefixes, "tid bigint, node bigint, depth bigint, next bigint, half boolean"), "prefixes")
    kept = written(spark, rows.groupBy("node").agg(
        F.min("next").alias("least"), F.max("next").alias("most"), F.bool_or("half").alias("forced"), F.count(F.lit(1)).alias("n"),
    ).where("least <> most OR least = 0 OR forced").select("node", (F.col("least") == 0).alias("ends"), "n"), "nodes")
    hot = _hot_nodes(spark, kept, rows.count())
    steps = _dealt_join(rows.select("tid", "node", "depth"), kept.drop("n"), hot)
    paths = steps.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct(F.col("depth").cast("int").alias("depth"), "node", "ends"))).alias("path"))
    walks = written(spark, walks.join(paths, "tid"), "paths")  # a path has at most one place per letter of its word
    pair = F.transform(F.slice("path", 1, F.size("path") - 1), lambda a, i: F.struct(a.alias("a"), F.get("path", i + 1).alias("b")))
    steps = walks.select("text", F.explode(pair).alias("p")).select(
        F.col("p.a.node").alias("node"), F.col("p.b.node").alias("child"), F.col("p.b.ends").alias("ends"),
        F.substring("text", F.col("p.a.depth") + 1, F.col("p.b.depth") - F.col("p.a.depth")).alias("label"),
        (F.length("text") - F.col("p.b.depth")).alias("rest"))
    edges = steps.groupBy("node", "child").agg(
        F.min("label").alias("label"), F.bool_or("ends").alias("ends"), F.min("rest").alias("low"), F.max("rest").alias("high"))
    edges = written(spark, edges, "edges")
    begins = edges.groupBy(F.col("node").alias("child")).agg(F.array_join(F.collect_set(F.substring("label", 1, 1)), "").alias("nexts"))
    return walks, written(spark, edges.join(begins, "child", "left").withColumn("nexts", F.coalesce("nexts", F.lit(""))), "begun"), hot


def _hot_nodes(spark: SparkSession, nodes: DataFrame, rows: int) -> DataFrame:
    """``node``, ``salts`` of the nodes with more than 1/256 of all prefixes, so fewer than 256 of them."""
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return nodes.where(F.col("n") * HOT_SHARE > rows).select(
        "node", (F.ceil(F.col("n") * tasks / F.lit(max(rows, 1))) + 1).cast("int").alias("salts"))


def _dealt_join(left: DataFrame, right: DataFrame, hot: DataFrame) -> DataFrame:
    """An inner join on ``node``; rows of a hot node are dealt by their ``tid``, and the node's few rows of ``right`` copied to each salt."""
    n = F.coalesce(F.col("salts"), F.lit(1))
    dealt = left.join(F.broadcast(hot), "node", "left").withColumn("salt", F.pmod(F.xxhash64("tid"), n).cast("int")).drop("salts")
    copied = right.join(F.broadcast(hot), "node", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("salts")
    return dealt.join(copied, ["node", "salt"]).drop("salt")


_HERE, _MORE = "substring(text, pos + 1, length(label))", "substring(text, pos + 1, length(label) + 1)"
# A state goes on if a word ends where its own word does, or if an edge begins with its word's next letter.
_GOES_ON = "CASE WHEN pos = length(text) THEN ends ELSE instr(nexts, substring(text, pos + 1, 1)) > 0 END"


def _one_edit(walks: DataFrame, edges: DataFrame, hot: DataFrame) -> DataFrame:
    """The states after the one edit: those without an edit, at every place of a word's way, joined with the edges that go on from there."""
    ways = walks.select("tid", "back", "text", "n", "half", F.explode("path").alias("p")).select(
        "tid", "back", "text", "n", "half", F.col("p.depth").alias("pos"), F.col("p.node").alias("node"), F.col("p.ends").alias("here_ends"))
    here, more, size, left = F.expr(_HERE), F.expr(_MORE), F.length("label"), F.length("text") - F.col("pos")
    # No edit before the half: the ways begin there. The rest must fit the words behind the edge, so the label's letters are all there.
    fits = lambda rest: rest.between(F.col("low"), F.col("high"))
    single = lambda c, one: F.when(size == 1, one).otherwise(F.levenshtein(c, "label", 1) == 1)
    replaced = fits(left - size) & (here < F.col("label")) & single(here, F.lit(True))
    left_out = fits(left - size - 1) & (here != F.col("label")) & single(more, F.substr("text", F.col("pos") + 2, F.lit(1)) == F.col("label"))
    # Most edges fall out, so they do before an array is made.
    after = lambda step: F.col("pos") + size + step
    made = _dealt_join(ways.drop("here_ends"), edges, hot).where(replaced | left_out).select(
        "tid", "back", "text", "n", "half", F.col("child").alias("node"), "ends", "nexts",
        F.explode(F.when(~left_out, F.array(after(0))).when(~replaced, F.array(after(1))).otherwise(F.array(after(0), after(1)))).alias("pos"))
    made = made.where(_GOES_ON).drop("nexts")
    # The last letter left out: the word's own way ends a word one letter before its end.
    last = ways.where("here_ends AND pos = length(text) - 1").select("tid", "back", "text", "n", "half", "node", F.col("here_ends").alias("ends"), F.length("text").alias("pos"))
    return made.unionByName(last)


def _advanced(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    """One level on: the edge that begins with the word's next letter, if all its letters stand there."""
    first = lambda c, at: F.xxhash64("node", F.substring(c, at, F.lit(1)))
    asked = frontier.withColumn("key", first("text", F.col("pos") + 1)).drop("node", "ends")
    known = edges.withColumn("key", first("label", F.lit(1))).drop("node")
    rest = F.length("text") - F.col("pos") - F.length("label")
    met = asked.join(known, "key").where((F.expr(_HERE) == F.col("label")) & rest.between(F.col("low"), F.col("high")))
    return met.select(
        "tid", "back", "text", "n", "half", F.col("child").alias("node"), "ends", "nexts", (F.col("pos") + F.length("label")).alias("pos"),
    ).where(_GOES_ON).drop("nexts")


def neighbours(spark: SparkSession, words: DataFrame) -> DataFrame:
    """``word``, ``n``, ``near``, ``near_n`` for all pairs of distinct words (``word``, ``n``) that are one edit apart, both ways round."""
    walks, edges, hot = trie(spark, words)
    at_end, hits = F.col("pos") == F.length("text"), None
    frontier = _one_edit(walks, edges, hot)
    while True:
        frontier = written(spark, frontier, "level")
        found = frontier.where(at_end).select("back", "text", "n", "half", "node")
        hits = found if hits is None else hits.union(found)
        frontier = frontier.where(~at_end)
        if frontier.isEmpty():
            break
        frontier = _advanced(frontier, edges)
    turned = lambda c: F.when(F.col("back") == 1, F.reverse(c)).otherwise(F.col(c))
    ends = walks.select("back", F.element_at("path", -1)["node"].alias("node"), F.col("text").alias("near"), F.col("n").alias("near_n"))
    pairs = hits.join(ends, ["back", "node"]).where(F.levenshtein("text", "near", 1) == 1).select(
        "back", "half", turned("text").alias("word"), "n", turned("near").alias("near"), "near_n")
    # A letter left out of a run of equal letters over the half is found from both ends: the front walk's pair counts.
    front = F.length("word") - F.col("half")
    pairs = pairs.where((F.col("back") == 0) | (F.substring("word", F.lit(1), front) != F.substring("near", F.lit(1), front)))
    way = lambda *c: F.struct(*(F.col(x).alias(y) for x, y in zip(c, ("word", "n", "near", "near_n"))))
    return pairs.select(F.inline(F.array(way("word", "n", "near", "near_n"), way("near", "near_n", "word", "n"))))


def variants(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT, factor: int = FACTOR, damage: int = DAMAGE,
) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` for every word of the corpus."""
    words = written(spark, word_counts(spark, df, id_col, text_col, min_length, min_count, damage), "words")
    near = neighbours(spark, words).groupBy("word", "n").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("near"))).alias("best"))
    chosen = -F.col("best.n") >= factor * F.col("n")
    forms = near.select("word", "n_near", F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.n")).alias("form_n"))
    table = written(spark, words.join(forms, "word", "left"), "forms")
    return table.join(_roots(spark, table), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def _roots(spark: SparkSession, table: DataFrame) -> DataFrame:
    """``word``, ``root`` of every word with a form, by pointer doubling: counts grow by the factor at each step, so chains are short."""
    at = written(spark, table.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        at = written(spark, salted_lookup(at, on, "root", "word", "left").select(
            "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("word", "root")
        at = at.select("word", "root")
