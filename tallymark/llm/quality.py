"""Quality classifier: document evidence combined with site posteriors by hierarchical empirical Bayes.

A logistic regression over hashed words and the beginnings of words (presence, those that tell good from bad documents) and style measures is fitted on at most ``FIT_ROWS`` labelled documents
(those with the smallest hashes of their ids); a document is good if its quality label is 1 and its toxic label is not. Each document's evidence is the
log odds of the classifier less the log odds of the sample. Sites form a tree: all documents, host, path. The share of good documents of
a host is shrunk toward the global share, that of a path toward its host's, by a beta prior whose strength is found from
the spread between sites (method of moments), so a site with few documents keeps its parent's share. Counts are the
classifier's own probabilities, summed by grouped aggregation over all documents; a document's own is left out of
its path's. Its posterior log odds are its evidence plus the log odds of its path's shrunken share.

Defined cases: a null text counts as empty; a null host or path is a site of its own; labels of unknown documents, and null
labels, are not used; without labels of both kinds nothing is known, so every document is kept with probability 1; repeated rows are judged
each; an empty table gives an empty table; further columns are passed on by ``accepted`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.words import LETTERED, Words, slices, small_batches
from tallymark.session import written

FIT_ROWS = 20_000
WORD_BITS = 18
PREFIXES = (4, 6)  # bytes
REGULARISATION = 3e-4
EVIDENCE = 15.0
KEEP = 0.5
SITES_IN_MEMORY = 50_000
STYLE = (
    "upper", "digit", "mark", "pipe", "shout", "junk", "beyond_ascii", "line_end", "repeated_words", "repeated_lines",
    "marked_words", "short", "empty")
STYLE_WEIGHT = 10.0
DIMENSIONS = (1 << WORD_BITS) + len(STYLE)
_EPSILON = 1e-6


def _set(values: bytes) -> np.ndarray:
    table = np.zeros(256, np.int64)
    table[list(values)] = 1
    return table


_ALNUM = [*range(48, 58), *range(65, 91), *range(97, 123)]
_TABLES = [
    _set(bytes(range(65, 91))), _set(bytes(range(48, 58))),
    _set(bytes(x for x in range(33, 127) if x not in _ALNUM)), _set(b"|"), _set(b"!"), _set(b"#$%&*"),
    _set(bytes(range(128, 256))), _set(b"\n"),
]


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sparse features of each text: sorted places and values."""
    for start, stop in slices(texts):
        batch = Words(texts[start:stop])
        lines = Words(texts[start:stop], ~_set(b"\n").astype(bool))
        words, line_hashes = batch.hashes(), lines.hashes()
        letters = Words(texts[start:stop], LETTERED)
        parts = [letters.hashes()] + [letters.hashes(n) ^ np.uint64(n) << np.uint64(60) for n in PREFIXES]
        parts = [p >> np.uint64(64 - WORD_BITS) for p in parts]
        sums = []
        for table in _TABLES:
            total = np.concatenate([[0], np.cumsum(table[batch.raw])])
            sums.append(total[batch.bounds[1:]] - total[batch.bounds[:-1]])
        size = np.maximum(np.diff(batch.bounds), 1)
        ends = _TABLES[2][batch.data[batch.ends - 1]] if len(words) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(ends)])
        for row in range(stop - start):
            low, high = batch.first[row], batch.first[row + 1]
            distinct = np.unique(words[low:high])
            own_lines = line_hashes[lines.first[row]: lines.first[row + 1]]
            n = max(1, high - low)
            style = [s[row] / size[row] for s in sums] + [
                1 - len(distinct) / n, 1 - len(np.unique(own_lines)) / max(1, len(own_lines)),
                (ends[high] - ends[low]) / n, 1 / n, float(high == low)]
            a, z = letters.first[row], letters.first[row + 1]
            places = np.unique(np.concatenate([p[a:z] for p in parts])).astype(np.int64)
            style = np.array(style) * STYLE_WEIGHT
            yield (
                np.concatenate([places, (1 << WORD_BITS) + np.arange(len(STYLE))]),
                np.concatenate([np.ones(len(places)), style]))


class Model:
    """Weights, intercept and the log odds of the sample it was fitted on."""

    def __init__(self, weights: np.ndarray, intercept: float, prior: float):
        self.weights, self.intercept, self.prior = weights, intercept, prior

    def log_odds(self, texts: pa.Array) -> np.ndarray:
        return np.array([self.weights[places] @ values for places, values in features(texts)]) + self.intercept


def fit(
    spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    rows: int = FIT_ROWS,
) -> Model | None:
    """Fit on a bounded sample of labelled documents; None if it lacks one of the two kinds."""
    small_batches(spark)
    known = labels.select(
        F.col(id_col).alias("id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) != 1)).cast("double").alias("y"),
    ).where("id IS NOT NULL AND y IS NOT NULL").groupBy("id").agg(F.min("y").alias("y"))
    sample = {r["id"]: r["y"] for r in known.orderBy(F.xxhash64("id"), "id").limit(rows).collect()}
    truth = spark.sparkContext.broadcast(sample)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            chosen = [k for k, i in enumerate(ids) if i in truth.value]
            if chosen:
                places, values = zip(*features(batch.column(1).take(pa.array(chosen))))
                yield pa.RecordBatch.from_arrays([
                    pa.array([truth.value[ids[k]] for k in chosen]), pa.array([p.astype(np.int32) for p in places], pa.list_(pa.int32())),
                    pa.array(values, pa.list_(pa.float64()))], ["label", "places", "values"])

    found = written(spark, df.select(F.col(id_col), F.col(text_col)).mapInArrow(
        task, "label double, places array<int>, values array<double>"), "sample")
    n, good = found.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or good in (0, n):
        return None
    telling = _telling(found, n, good)

    def narrow(places, values):
        at = np.minimum(np.searchsorted(telling, places), len(telling) - 1)
        same = telling[at] == places
        return SparseVector(len(telling), at[same], np.array(values)[same])

    vector = F.udf(narrow, VectorUDT())
    ready = found.select("label", vector("places", "values").alias("features")).persist()
    fitted = LogisticRegression(
        maxIter=40, regParam=REGULARISATION, standardization=False, aggregationDepth=2).fit(ready)
    ready.unpersist()
    weights = np.zeros(DIMENSIONS)
    weights[telling] = fitted.coefficients.toArray()
    return Model(weights, fitted.intercept, float(np.log(good / (n - good))))


def _telling(sample: DataFrame, n: int, good: float) -> np.ndarray:
    """The places that the regression uses, sorted: words that tell good from bad documents, and all style places.

    A place is used if its share of good documents differs from the whole sample's by more than chance: a likelihood ratio of
    at least ``EVIDENCE``. Without that, words that single documents happen to have would drown the few that matter.
    """
    counts = sample.select("label", F.explode("places").alias("place")).groupBy("place").agg(
        F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    part = lambda k, m, share: F.when(k > 0, k * F.log(k / (m * share))).otherwise(0.0)
    bad, p = F.col("n") - F.col("good"), good / n
    ratio = 2 * (
        part(F.col("good"), F.col("n"), F.lit(p)) + part(bad, F.col("n"), F.lit(1 - p))
        + part(good - F.col("good"), F.lit(float(n)) - F.col("n"), F.lit(p))
        + part(n - good - bad, F.lit(float(n)) - F.col("n"), F.lit(1 - p)))
    chosen = np.zeros(DIMENSIONS, bool)
    chosen[1 << WORD_BITS:] = True
    for row in counts.where((ratio >= EVIDENCE) & (F.col("place") < 1 << WORD_BITS)).select("place").toLocalIterator():
        chosen[row["place"]] = True
    return np.flatnonzero(chosen)


def with_log_odds(spark: SparkSession, df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``df`` with the classifier's log odds as the last column, ``_log_odds``; all other columns pass as they are."""
    place = df.columns.index(text_col)
    schema = df.select("*", F.lit(0.0).alias("_log_odds")).schema
    shared = spark.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = shared.value.log_odds(batch.column(place)) if shared.value else np.full(batch.num_rows, np.inf)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.float64())], [f.name for f in schema])

    return df.mapInArrow(task, schema)


def _share(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _odds(share: Column) -> Column:
    bounded = F.least(F.greatest(share, F.lit(_EPSILON)), F.lit(1 - _EPSILON))
    return F.log(bounded / (1 - bounded))


def _strength(sites: DataFrame, parent: str) -> float:
    """Strength of the beta prior around ``parent`` shares, from how far sites spread beyond chance."""
    spread = F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col(parent), 2))
    chance = F.sum((F.col("s") - F.col("ss")) / F.col("n") + (F.col("ss") / F.col("n") - F.pow(F.col("s") / F.col("n"), 2)))
    row = sites.agg(spread.alias("a"), chance.alias("b"), F.sum("n").alias("n"), F.avg(F.col(parent) * (1 - F.col(parent))).alias("v")).first()
    if not row["n"]:
        return 1.0
    between = max((row["a"] - row["b"]) / row["n"], 1e-9)
    return float(min(max(row["v"] / between - 1, 1.0), 1e6))


def site_shares(scores: DataFrame) -> tuple[DataFrame, float]:
    """``host``, ``path``, ``n``, ``s``, shrunken ``host_share`` and the strength of the path prior, from rows of ``p``."""
    paths = scores.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss"))
    paths = written(scores.sparkSession, paths, "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    total = hosts.agg(F.sum("s") / F.sum("n")).first()[0]
    hosts = hosts.withColumn("global_share", F.lit(float(total if total is not None else 1.0)))
    strength = _strength(hosts, "global_share")
    shrunk = hosts.select(F.col("host").alias("h"), (
        (F.col("s") + strength * F.col("global_share")) / (F.col("n") + strength)).alias("host_share"))
    joined = paths.join(shrunk, F.col("host").eqNullSafe(F.col("h"))).drop("h")
    return joined, _strength(joined, "host_share")


def _posterior(rows: DataFrame, sites: DataFrame, strength: float, prior: float) -> DataFrame:
    """Add ``site_share`` and ``posterior`` to rows with ``_host``, ``_path`` and ``_log_odds``."""
    small = sites.count() <= SITES_IN_MEMORY
    table = sites.select(F.col("host").alias("_h"), F.col("path").alias("_t"), "n", "s", "host_share").select(
        "_h", "_t", F.struct("n", "s", "host_share").alias("_site"))
    table = F.broadcast(table) if small else table  # beyond that, a join that Spark splits at hot sites
    found = rows.join(table, F.col("_host").eqNullSafe(F.col("_h")) & F.col("_path").eqNullSafe(F.col("_t")), "left")
    own = _share(F.col("_log_odds"))
    share = (F.col("_site.s") - own + strength * F.col("_site.host_share")) / (F.col("_site.n") - 1 + strength)
    found = found.withColumn("_share", share)
    return found.withColumn("_posterior", _share(F.col("_log_odds") - prior + _odds(F.col("_share")))).drop("_h", "_t", "_site")


def _sites(scored: DataFrame) -> tuple[DataFrame, float]:
    return site_shares(scored.select(
        F.col("_host").alias("host"), F.col("_path").alias("path"), _share(F.col("_log_odds")).alias("p")))


def judged(
    spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """``doc_id``, ``host``, ``path``, ``classifier``, ``site_share``, ``posterior``, ``accepted`` of each row.

    Documents carry no url, so by default ``source`` stands for the host and ``lang`` for the path.
    """
    model = fit(spark, df, labels, id_col, text_col)
    narrow = df.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), F.col(text_col).alias("text"))
    scored = written(spark, with_log_odds(spark, narrow, model).drop("text"), "scores")
    sites, strength = _sites(scored)
    return _posterior(scored, sites, strength, model.prior if model else 0.0).select(
        "doc_id", F.col("_host").alias("host"), F.col("_path").alias("path"), _share(F.col("_log_odds")).alias("classifier"),
        F.col("_share").alias("site_share"), F.col("_posterior").alias("posterior"), (F.col("_posterior") >= KEEP).alias("accepted"))


def accepted(
    spark: SparkSession, df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    host_col: str = "source", path_col: str = "lang",
) -> DataFrame:
    """The rows of ``df`` that are kept, all columns as they are. Texts are scored twice rather than shuffled."""
    model = fit(spark, df, labels, id_col, text_col)
    scored = with_log_odds(spark, df.select(
        F.col(host_col).alias("_host"), F.col(path_col).alias("_path"), F.col(text_col).alias("text")), model)
    sites, strength = _sites(written(spark, scored.drop("text"), "scores"))
    columns = [f"c{k}" for k in range(len(df.columns))]  # names of our own, so none of the caller's can clash
    at = {name: columns[df.columns.index(name)] for name in (text_col, host_col, path_col)}
    rows = with_log_odds(spark, df.toDF(*columns), model, at[text_col]).select(
        "*", F.col(at[host_col]).alias("_host"), F.col(at[path_col]).alias("_path"))
    kept = _posterior(rows, sites, strength, model.prior if model else 0.0).where(F.col("_posterior") >= KEEP)
    return kept.select(*columns).toDF(*df.columns)
