"""Language model scoring: a hidden Markov model over words, trained by Baum-Welch on Spark.

Tokens are runs of anything but ASCII white space with A-Z in lower case, and one end token per text. Words map to
classes: a word that makes up more than 1 in ``FREQUENT`` of the training tokens (so there are fewer of them than that) is a
class of its own, so is the end; all others share ``RARE_CLASSES`` classes by the hash of their last three bytes and length.
The model has ``STATES`` latent states with start and transition probabilities, emits classes by state, and words by
class: P(word | class) = (count + 1) / (class count + class words + 1), with count 0 for words not seen. So the
log probability of a text is that of its class sequence, by the exact scaled forward recursion, plus that of its words
given their classes.

How it runs: (1) word counts of all training texts, by grouped aggregation; (2) one pass turns every text into its class
sequence, written as a table, and into postings (word, rows, counts) of the words that are not frequent; (3) each Baum-Welch round is one pass
over the class sequences: every task adds up its expected counts over texts in batches of similar length, and the tasks' tables (states x
classes, a fixed size) are added up by Spark; (4) postings are joined with the counts and summed by row. Only tables of fixed
size reach the driver; the counts of all words stay on Spark.

Defined cases: a null or empty text has the end token alone; a null id is held out or not by the checksum of an empty text; repeated rows
are scored each; without training texts all counts are zero and states are uniform; an empty table gives an empty table; other columns are not read.
Rows are told apart by a number given when they are written, never by id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.words import Words, mix, slices, small_batches
from tallymark.session import written

FOLDS, HELD_OUT = 7, 2
FREQUENT = 4096
RARE_CLASSES = 512
STATES = 4
ROUNDS = 3
SEED = 42
TOKENS_TOGETHER = 1_000_000
TEXTS_TOGETHER = 512
STEPS_TOGETHER = 1 << 19
_SMOOTH = 0.01
_EMPTY = np.zeros(0, np.int64)


def held_out(ids) -> np.ndarray:
    """Whether the checksum of each id's decimal text has the held-out remainder."""
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, stop in slices(batch.column(1)):
            yield batch.slice(start, stop - start)


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray], words: list[pa.Array]):
    """Distinct words of several slices with their counts."""
    every, sums = np.concatenate(hashes), np.concatenate(counts)
    _, first, where = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(where, weights=sums, minlength=len(first)).astype(np.int64)
    return pa.concat_arrays(words).take(pa.array(first)), total


def word_counts(spark: SparkSession, source: DataFrame) -> DataFrame:
    """``word``, ``c`` over the training texts. Tasks add up words over a few million tokens before Spark sees them."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, words, held = [], [], [], 0

        def flush():
            found, total = _summed(hashes, counts, words)
            return pa.RecordBatch.from_arrays([found, pa.array(total)], ["word", "n"])

        for part in _parts(batches):
            train = np.flatnonzero(~held_out(part.column(0).to_pylist()))
            batch = Words(part.column(1).take(pa.array(train)))
            if not len(batch.starts):
                continue
            every, first, count = np.unique(batch.hashes(), return_index=True, return_counts=True)
            hashes.append(every)
            counts.append(count)
            words.append(batch.strings(first))
            held += len(every)
            if held >= TOKENS_TOGETHER:
                yield flush()
                hashes, counts, words, held = [], [], [], 0
        if hashes:
            yield flush()

    rows = source.select("id", "text").mapInArrow(task, "word string, n bigint")
    return written(spark, rows.groupBy("word").agg(F.sum("n").alias("c")), "counts")


class Vocabulary:
    """Class of every word: 0 is the end, then the frequent words, then the classes of the rest."""

    def __init__(self, frequent: dict[str, int]):
        self.words = sorted(frequent)
        hashes = Words(pa.array(self.words, pa.large_string())).hashes() if self.words else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.place = hashes[order], order + 1
        self.log_counts = np.array([0.0, *[np.log10(frequent[w] + 1) for w in self.words]])
        self.first_rare = len(self.words) + 1
        self.classes = self.first_rare + RARE_CLASSES

    def of(self, batch: Words, hashes: np.ndarray) -> np.ndarray:
        size = batch.ends - batch.starts
        tail = np.minimum(size, 15).astype(np.uint64)
        for back in (1, 2, 3):
            byte = batch.data[np.maximum(batch.ends - back, batch.starts)].astype(np.uint64)
            tail = (tail << np.uint64(8)) | byte
        out = self.first_rare + (mix(tail) % np.uint64(RARE_CLASSES)).astype(np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            same = self.hashes[at] == hashes
            out[same] = self.place[at[same]]
        return out


def _encoded(spark: SparkSession, source: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Two kinds of rows in one table: texts with their class sequence, and postings of words that are not frequent.

    Words that are not frequent occur in fewer than 1 of ``FREQUENT`` tokens, so their postings are no hot keys.
    """
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = (
        "kind string, doc_id bigint, row bigint, held_out boolean, n_tokens bigint, frequent bigint, frequent_log double, "
        "classes binary, word string, class int, rows array<int>, times array<int>")
    names = [x.split()[0] for x in schema.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, base, number = shared.value, TaskContext.get().partitionId() << 40, 0
        hashes, words, classes, rows, times, kept = [], [], [], [], [], 0
        for part in _parts(batches):
            ids = part.column(0).to_pylist()
            batch = Words(part.column(1))
            every = batch.hashes()
            own = vocabulary.of(batch, every)
            rare = own >= vocabulary.first_rare
            row = np.repeat(np.arange(len(ids)), batch.counts)
            logs = np.where(rare, 0.0, vocabulary.log_counts[np.where(rare, 0, own)])
            n = len(ids)
            sequences = [
                np.append(own[batch.first[k]: batch.first[k + 1]], 0).astype("<u2").tobytes() for k in range(n)]
            none = lambda kind: pa.nulls(n, kind)
            yield pa.RecordBatch.from_arrays([
                pa.array(["text"] * n), pa.array(ids, pa.int64()), pa.array(base + number + np.arange(n)), pa.array(held_out(ids)),
                pa.array(batch.counts + 1), pa.array(np.bincount(row[~rare], minlength=n).astype(np.int64)),
                pa.array(np.bincount(row, weights=logs, minlength=n).astype(np.float64)), pa.array(sequences, pa.binary()), none(pa.string()),
                none(pa.int32()), none(pa.list_(pa.int32())), none(pa.list_(pa.int32()))], names)
            at = np.flatnonzero(rare)
            if len(at):
                order = at[np.lexsort((row[at], every[at]))]
                new = np.concatenate([[True], (every[order][1:] != every[order][:-1]) | (row[order][1:] != row[order][:-1])])
                cut = np.flatnonzero(new)
                hashes.append(every[order[cut]])
                words.append(batch.strings(order[cut]))
                classes.append(own[order[cut]])
                rows.append(number + row[order[cut]])
                times.append(np.diff(np.append(cut, len(order))))
                kept += len(cut)
            number += n
            if kept >= TOKENS_TOGETHER:
                yield _postings(base, hashes, words, classes, rows, times, names)
                hashes, words, classes, rows, times, kept = [], [], [], [], [], 0
        if kept:
            yield _postings(base, hashes, words, classes, rows, times, names)

    return written(spark, source.select("id", "text").mapInArrow(task, schema), "encoded")


def _postings(base, hashes, words, classes, rows, times, names) -> pa.RecordBatch:
    """One row per word; its ``row`` is the task's base number, to which the numbers in ``rows`` are added."""
    every = np.concatenate(hashes)
    order = np.argsort(every, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], every[order][1:] != every[order][:-1]]))
    bounds = pa.array(np.append(first, len(order)), pa.int32())
    n = len(first)
    none = lambda kind: pa.nulls(n, kind)
    return pa.RecordBatch.from_arrays([
        pa.array(["word"] * n), none(pa.int64()), pa.array(np.full(n, base)), *[none(k) for k in (
            pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary())],
        pa.concat_arrays(words).take(pa.array(order[first])),
        pa.array(np.concatenate(classes)[order[first]], pa.int32()),
        pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(rows)[order].astype(np.int32))),
        pa.ListArray.from_arrays(bounds, pa.array(np.concatenate(times)[order].astype(np.int32))),
    ], names)


# The hidden Markov model ---------------------------------------------------------------------------------------------

class Chain:
    """Start (K), transition (K x K) and emission (K x classes) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, shares: np.ndarray, states: int = STATES, seed: int = SEED) -> Chain:
        """Near the classes' overall shares, pushed apart by a seeded draw."""
        random = np.random.default_rng(seed)
        emit = shares * np.exp(random.normal(0, 0.5, (states, len(shares))))
        move = np.full((states, states), 1.0) + 2 * random.random((states, states))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def counted(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Chain:
        add = lambda x: (x + _SMOOTH) / (x + _SMOOTH).sum(-1, keepdims=True)
        return cls(add(start), add(move), add(emit))

    def forward(self, texts: list[np.ndarray]) -> np.ndarray:
        """Natural log probability of each class sequence; texts are of similar length, longest first."""
        lengths = np.array([len(t) for t in texts])
        emit, logs = np.ascontiguousarray(self.emit.T), np.zeros(len(texts))
        alpha = np.empty(0)
        for t, codes in _steps(texts, lengths):
            n = len(codes)
            alpha = (self.start if t == 0 else alpha[:n] @ self.move) * emit[codes]
            scale = alpha.sum(1)
            alpha /= scale[:, None]
            logs[:n] += np.log(scale)
        return logs

    def expected(self, texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit_t: np.ndarray) -> None:
        """Add the expected counts of start states, transitions and emissions of these texts.

        A longer text goes through in stretches of ``STEPS_TOGETHER`` steps, each treated as a text of its own in training only.
        """
        lengths = np.array([len(t) for t in texts])
        emit, states = np.ascontiguousarray(self.emit.T), len(self.start)
        steps = list(_steps(texts, lengths))
        alphas, scales = [], []
        for t, codes in steps:
            alpha = (self.start if t == 0 else alphas[-1][: len(codes)] @ self.move) * emit[codes]
            scale = alpha.sum(1, keepdims=True)
            alphas.append(alpha / scale)
            scales.append(scale)
        beta = np.ones((len(steps[-1][1]), states))
        gammas = [None] * len(steps)
        for t in range(len(steps) - 1, -1, -1):
            codes = steps[t][1]
            if t < len(steps) - 1:
                after = steps[t + 1][1]
                ahead = emit[after] * beta / scales[t + 1]
                move += self.move * (alphas[t][: len(after)].T @ ahead)
                back = np.ones((len(codes), states))
                back[: len(after)] = ahead @ self.move.T
                beta = back
            gammas[t] = alphas[t] * beta
        start += gammas[0].sum(0)
        codes, gamma = np.concatenate([c for _, c in steps]), np.concatenate(gammas)
        for k in range(states):
            emit_t[k] += np.bincount(codes, weights=gamma[:, k], minlength=emit_t.shape[1])


def _steps(texts: list[np.ndarray], lengths: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The class at each step of all texts that are that long (texts come longest first)."""
    data, first = np.concatenate(texts), np.cumsum(lengths) - lengths
    alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    for t in range(lengths[0]):
        yield t, data[first[: alive[t]] + t]


def _groups(sequences: list[np.ndarray]) -> Iterator[list[int]]:
    """Places of texts, longest first, in groups with a bound on padded steps and number."""
    order = sorted(range(len(sequences)), key=lambda k: -len(sequences[k]))
    at = 0
    while at < len(order):
        size = max(1, min(TEXTS_TOGETHER, STEPS_TOGETHER // max(1, len(sequences[order[at]]))))
        yield order[at: at + size]
        at += size


def _stretches(sequence: np.ndarray) -> list[np.ndarray]:
    return [sequence[k: k + STEPS_TOGETHER] for k in range(0, len(sequence), STEPS_TOGETHER)]


def baum_welch(spark: SparkSession, texts: DataFrame, chain: Chain, rounds: int = ROUNDS) -> Chain:
    """Rounds of re-estimation over the rows of ``classes``: counts are added up by task, then by Spark."""
    states, classes = chain.emit.shape
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(chain)

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, classes))
            for batch in batches:
                sequences = [s for b in batch.column(0) for s in _stretches(np.frombuffer(b.as_py(), "<u2").astype(np.int64))]
                for group in _groups(sequences):
                    shared.value.expected([sequences[k] for k in group], start, move, emit)
            every = np.concatenate([start, move.ravel(), emit.ravel()])
            used = np.flatnonzero(every)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(every[used])], ["place", "n"])

        sums = texts.select("classes").mapInArrow(task, "place bigint, n double").groupBy("place").agg(F.sum("n").alias("n"))
        total = np.zeros(states + states * states + states * classes)
        for row in sums.toLocalIterator():
            total[row["place"]] = row["n"]
        if not total.any():
            return chain
        a, b = states, states + states * states
        chain = Chain.counted(total[:a], total[a:b].reshape(states, states), total[b:].reshape(states, classes))
    return chain


def scored(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of each row."""
    source = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    small_batches(spark)
    counts = word_counts(spark, source)

    def training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([int((~held_out(batch.column(0).to_pylist())).sum())])], ["n"])

    ends = source.select("id").mapInArrow(training, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words, kinds = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = words + ends, kinds + (ends > 0)
    frequent = {r["word"]: r["c"] for r in counts.where(F.col("c") * FREQUENT > tokens).collect()}  # fewer than FREQUENT
    vocabulary = Vocabulary(frequent)
    encoded = _encoded(spark, source, vocabulary)
    texts = encoded.where("kind = 'text'")

    # Counts of the rare words met, with their class, and the class totals.
    postings = encoded.where("kind = 'word'").select("word", "class", F.col("row").alias("base"), "rows", "times")
    joined = postings.join(counts, "word", "left").select("class", "base", "rows", "times", F.coalesce("c", F.lit(0)).alias("c"))
    each = joined.select("class", "c", "base", F.explode(F.arrays_zip("rows", "times")).alias("e")).select(
        "class", (F.col("base") + F.col("e.rows")).alias("row"), F.col("e.times").alias("n"), "c")
    totals = np.zeros((2, RARE_CLASSES))
    for row in _class_totals(counts, vocabulary).toLocalIterator():
        totals[:, row["class"] - vocabulary.first_rare] = row["c"], row["v"]
    log_class = np.log10(totals.sum(0) + 1)
    given = F.element_at(F.array(*map(F.lit, log_class.tolist())), F.col("class") - F.lit(vocabulary.first_rare - 1))
    sums = each.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known"),
        F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("logs"), F.sum(F.col("n") * given).alias("class_logs"))

    shares = np.zeros(vocabulary.classes) + 1.0
    shares[0] += ends
    for k, word in enumerate(vocabulary.words):
        shares[k + 1] += frequent[word]
    shares[vocabulary.first_rare:] += totals[0]
    chain = baum_welch(spark, texts.where("NOT held_out"), Chain.first(shares / shares.sum()))
    shared = spark.sparkContext.broadcast(chain)

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequences = [np.frombuffer(b.as_py(), "<u2").astype(np.int64) for b in batch.column(6)]
            logs = np.zeros(len(sequences))
            for group in _groups(sequences):
                logs[group] = shared.value.forward([sequences[k] for k in group])
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(logs / np.log(10))], [*batch.schema.names[:6], "chain"])

    columns = ["doc_id", "row", "held_out", "n_tokens", "frequent", "frequent_log"]
    kinds_of = "doc_id bigint, row bigint, held_out boolean, n_tokens bigint, frequent bigint, frequent_log double, chain double"
    rows = texts.select(*columns, "classes").mapInArrow(forward, kinds_of).join(sums, "row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    end_known, end_log = int(ends > 0), float(np.log10(ends + 1))
    return rows.select(
        "doc_id", "held_out", "n_tokens", (F.col("frequent") + zero("known") + end_known).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("frequent_log") + zero("logs") + end_log - F.col("n_tokens") * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        (F.col("chain") + zero("logs") - zero("class_logs")).alias("score"))


def _class_totals(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``class``, ``c``, ``v``: training tokens and distinct words of each class of rare words."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(0))
            own = vocabulary.of(words, words.hashes())
            counted = batch.column(1).to_numpy()
            used = np.unique(own[own >= vocabulary.first_rare])
            c, v = np.bincount(own, weights=counted, minlength=vocabulary.classes), np.bincount(own, minlength=vocabulary.classes)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(c[used].astype(np.int64)), pa.array(v[used].astype(np.int64))], ["class", "c", "v"])

    return counts.select("word", "c").mapInArrow(task, "class int, c bigint, v bigint").groupBy("class").agg(
        F.sum("c").alias("c"), F.sum("v").alias("v"))
