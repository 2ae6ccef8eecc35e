"""Document fingerprints: MinHash signatures over five-word shingles, banded candidate search, Jaccard check.

A shingle is five consecutive words (fewer words: the whole sequence), words being runs of anything but ASCII white
space with A-Z in lower case. ``PERMUTATIONS`` universal hash functions ``a * x + b mod 2**32`` (``a`` odd, so each
permutes the 32-bit values) are evaluated over the shingles of a text in numpy; the least value of each is the
signature. The fingerprint keeps 16 bits of each value (b-bit MinHash), so its likeness is the share of equal places less the
chance agreement of 1 in 65536.

Defined cases: a null text counts as empty; texts without words have one signature of their own (all ones) and so a
likeness of 1 to each other; equal texts have equal fingerprints; repeated rows are fingerprinted each on its own; a null id
sorts first; an empty table gives an empty table. Only the id and text columns are read, under internal names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.words import Words, mix, shingle_hashes, slices, small_batches
from tallymark.session import written

SHINGLE = 5
PERMUTATIONS = 128
BANDS, ROWS = 25, 5
THRESHOLD = 0.8
BLOCK = 1 << 17  # shingles
SEED = 42
_CHUNK = 4096
_KEPT_BITS = 16


def multipliers(permutations: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """The odd factors and the offsets of the hash functions, as columns."""
    random = np.random.default_rng(seed)
    a = random.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    b = random.integers(0, 1 << 32, permutations, dtype=np.uint64).astype(np.uint32)
    return a[:, None], b[:, None]


def signatures(texts: pa.Array, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, seed: int = SEED) -> np.ndarray:
    """One row of 32-bit values per text. Long texts are taken in chunks, so memory does not grow with them."""
    a, b = multipliers(permutations, seed)
    out = np.full((len(texts), permutations), 0xFFFFFFFF, np.uint32)
    for start, stop in slices(texts):
        words = Words(texts[start:stop])
        hashes, bounds = shingle_hashes(words.hashes(), words.first, shingle)
        values = (hashes >> np.uint64(32)).astype(np.uint32)
        for row in range(stop - start):
            for at in range(bounds[row], bounds[row + 1], _CHUNK):
                part = values[at: min(at + _CHUNK, bounds[row + 1])]
                least = (a * part + b).min(axis=1)
                out[start + row] = np.minimum(out[start + row], least)
    return out


def fingerprint_text(signature: np.ndarray) -> list[str]:
    """The kept bits of each signature in hexadecimal."""
    kept = (signature & np.uint32((1 << _KEPT_BITS) - 1)).astype(">u2")
    return [row.tobytes().hex() for row in kept]


def likeness(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of fingerprints, row by row: 0 to 1."""
    mask = np.uint32((1 << _KEPT_BITS) - 1)
    share = ((left & mask) == (right & mask)).mean(axis=1)
    chance = 1 / (1 << _KEPT_BITS)
    return np.clip((share - chance) / (1 - chance), 0, 1)


def with_signature(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``signature`` (array of 128 longs) and ``fingerprint`` of each row."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {dict(source.dtypes)['id']}, signature array<bigint>, fingerprint string"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signature = signatures(batch.column(1))
            bounds = pa.array(np.arange(0, signature.size + 1, signature.shape[1]), pa.int32())
            arrays = pa.ListArray.from_arrays(bounds, pa.array(signature.ravel().astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), arrays, pa.array(fingerprint_text(signature), pa.string())],
                ["id", "signature", "fingerprint"])

    return source.mapInArrow(task, schema)


# Classes of near duplicates ------------------------------------------------------------------------------------------

def near_classes(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """``id``, ``class_id``: rows joined by chains of texts with a shingle Jaccard of at least ``threshold``.

    The class id is the smallest id of the class. Rows with a null id are left out.
    """
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    rows, classes = labelled(spark, source, threshold)
    least = classes.groupBy("label").agg(F.min("low").alias("class_id"))
    return rows.join(classes.join(least, "label").select("copy", "class_id"), "copy").select("id", "class_id")


def representatives(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
) -> DataFrame:
    """``place`` (hash of the id) and ``copy`` of one row of each class: that of the smallest id, null ids last, then the least copy."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    _, classes = labelled(spark, source, threshold)
    least = classes.groupBy("label").agg(F.min(F.struct(F.col("low").isNull(), "low", "copy")).alias("row"))
    return least.select(F.xxhash64("row.low").alias("place"), "row.copy")


def copy_key(text):
    """16 bytes that name a text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def labelled(spark: SparkSession, source: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """``id``, ``copy`` of each row of ``source`` (``id``, ``text``), and ``copy``, ``low``, ``label`` of each distinct text.

    Equal texts are one node before the search, named by its ``copy``; ``low`` is its smallest id, ``label`` is common to a
    component. Signatures are cut into 25 bands of five values, and nodes that share a band are candidates. First each
    member of a band's group is held against the group's least node, so a large group of near copies is joined by n pairs. Then
    all members of a group that are not in one component yet are compared, block of nodes by block, so every pair that
    shares a band is either joined already or has its exact Jaccard taken. A pair of a Jaccard of 0.8 shares no band
    with a probability of 5e-5.
    """
    from tallymark.llm.components import components

    small_batches(spark)
    rows = written(spark, _banded(source), "bands")
    nodes = rows.groupBy("copy").agg(
        F.min("id").alias("low"), F.min(F.xxhash64("id")).alias("place"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    nodes = written(spark, nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bands = nodes.select("node", "size", F.explode("keys").alias("key"))
    groups = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("head")).where("n > 1")
    inside = written(spark, bands.join(groups, "key").select("key", "node", "size", "head"), "members")
    wanted = inside.select("node").distinct().join(nodes, "node").select("node", "copy", "place")
    texts = source.select(copy_key(F.col("text")).alias("copy"), F.xxhash64("id").alias("place"), "text").dropDuplicates(["copy", "place"])
    sets = written(spark, _shingle_sets(texts.join(wanted, ["copy", "place"]).select(F.col("node").alias("id"), "text")), "sets")
    pairs = inside.where("node <> head").select("node", "head").distinct()
    both = F.size(F.array_intersect("x", "y"))
    found = pairs.join(sets.select(F.col("id").alias("node"), F.col("shingles").alias("x")), "node").join(
        sets.select(F.col("id").alias("head"), F.col("shingles").alias("y")), "head",
    ).where(both >= F.lit(threshold) * (F.size("x") + F.size("y") - both))
    links = written(spark, found.select(F.col("head").alias("a"), F.col("node").alias("b")), "links")
    more = written(spark, _rest(spark, inside, sets, components(spark, links), threshold), "links")
    labels = components(spark, links.union(more)).withColumnRenamed("label", "_label")
    return rows.select("id", "copy"), nodes.join(labels, "node", "left").select(
        "copy", "low", F.coalesce("_label", "node").alias("label"))


def _rest(spark: SparkSession, inside: DataFrame, sets: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Links between members of a group, other than its head, that have different labels so far.

    A group's members are dealt into blocks of about ``BLOCK`` shingles. A label with more has blocks of its own, which are
    not held against each other.
    """
    members = inside.where("node <> head").join(labels, "node", "left").select(
        "key", "node", "size", F.coalesce("label", "node").alias("label"))
    parts = members.groupBy("key", "label").agg(F.sum("size").alias("weight")).withColumn("own", F.col("weight") > BLOCK)
    several = parts.groupBy("key").agg(
        F.count(F.lit(1)).alias("k"), F.sum(F.when(~F.col("own"), F.col("weight"))).alias("common")).where("k > 1")
    number = F.pmod(
        F.xxhash64(F.when(F.col("own"), F.col("node")).otherwise(F.col("label"))),
        F.ceil(F.when(F.col("own"), F.col("weight")).otherwise(F.col("common")) / BLOCK))
    dealt = members.join(parts.join(several, "key"), ["key", "label"]).select("key", "node", "label", F.struct(
        F.when(F.col("own"), F.col("label")).otherwise(-1).alias("of"), number.alias("number")).alias("block"))
    dealt = written(spark, dealt, "blocks")
    blocks = dealt.select("key", "block").distinct()
    tasks = blocks.withColumnRenamed("block", "x").join(blocks.withColumnRenamed("block", "y"), "key").where(
        "x <= y AND (x.of <> y.of OR x.of = -1)")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("block"), F.lit(0).alias("side")))).otherwise(
        F.array(*[F.struct(F.col(c).alias("block"), F.lit(k).alias("side")) for k, c in enumerate("xy", 1)]))
    sent = tasks.select("key", F.xxhash64("key", "x", "y").alias("task"), F.explode(sides).alias("s")).select(
        "key", "task", "s.block", "s.side").join(dealt, ["key", "block"])
    ready = sent.join(sets.withColumnRenamed("id", "node"), "node").select("task", "side", "node", "label", "shingles")

    def compare(block: pa.Table) -> pa.Table:
        side, node, label = (block.column(k).to_numpy() for k in (1, 2, 3))
        a, b = _similar(pa.concat_arrays(block.column(4).chunks), threshold)
        new = (label[a] != label[b]) & ((side[a] != side[b]) | (side[a] == 0))
        return pa.table({"a": node[a[new]], "b": node[b[new]]})

    return ready.groupBy("task").applyInArrow(compare, "a bigint, b bigint").distinct()


def _similar(sets: pa.Array, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of sets with at least the Jaccard ``threshold``; two empty sets are alike."""
    values, bounds = sets.flatten().to_numpy(zero_copy_only=False), np.asarray(sets.offsets) - sets.offsets[0].as_py()
    size = np.diff(bounds)
    distinct, at = np.unique(values, return_inverse=True)
    owner = np.repeat(np.arange(len(size)), size)[np.argsort(at, kind="stable")]
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(distinct)))]).astype(np.int64)
    left, right = [], []
    for row in range(len(size)):
        own = at[bounds[row]: bounds[row + 1]]
        n = first[own + 1] - first[own]
        places = np.arange(n.sum()) + np.repeat(first[own] - (np.cumsum(n) - n), n)
        both = np.bincount(owner[places], minlength=len(size))[row + 1:]
        near = np.flatnonzero(both >= threshold * (size[row] + size[row + 1:] - both)) + row + 1
        left.append(np.full(len(near), row))
        right.append(near)
    return np.concatenate(left), np.concatenate(right)


def _banded(source: DataFrame) -> DataFrame:
    """``id``, ``copy``, ``size`` (shingles and one) and the ``keys`` of the bands of each text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                signature = signatures(part.column(1)).astype(np.uint64)
                keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
                for k in range(ROWS):
                    keys = mix(keys * np.uint64(1 << 32 | 5) + signature[:, k: BANDS * ROWS: ROWS] + np.uint64(1))
                words = Words(part.column(1))
                bounds = pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32())
                copies = [hashlib.md5((t or "").encode()).digest() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), pa.array(copies, pa.binary()), pa.array(np.maximum(words.counts - SHINGLE + 1, 0) + 1, pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(keys.ravel().view(np.int64)))], ["id", "copy", "size", "keys"])

    return source.select("id", "text").mapInArrow(
        task, f"id {dict(source.dtypes)['id']}, copy binary, size bigint, keys array<bigint>")


def _shingle_sets(df: DataFrame) -> DataFrame:
    """``id`` and the distinct 64-bit shingle hashes of each text."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                words = Words(batch.column(1)[start:stop])
                hashes, bounds = shingle_hashes(words.hashes(), words.first, SHINGLE)
                sets = [np.unique(hashes[x:y].view(np.int64)) for x, y in zip(bounds, bounds[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[start:stop], pa.array(sets, pa.list_(pa.int64()))], ["id", "shingles"])

    return df.select("id", "text").mapInArrow(task, f"id {dict(df.dtypes)['id']}, shingles array<bigint>")


# Fingerprints of texts and of edits of them --------------------------------------------------------------------------

def _bounds(ids: DataFrame, pieces: int) -> list[int]:
    """Values that cut the ids into about even pieces; at most ``pieces``, a number of tasks and not of rows."""
    shares = [k / pieces for k in range(1, pieces)]
    found = ids.agg(F.percentile_approx("key", shares, 10_000)).first()[0] if shares else None
    return sorted(set(found or []))


def _piece(key, bounds: list[int]):
    """Number of bounds at or below ``key``: a search in two levels of about the square root of their number."""
    width = max(1, int(len(bounds) ** 0.5))
    rows = [bounds[k: k + width] for k in range(0, len(bounds), width)]
    if not rows:
        return F.lit(0)
    count = lambda values: F.size(F.filter(values, lambda x: x <= key))
    full = count(F.array(*[F.lit(row[0]) for row in rows]))
    inner = F.element_at(F.array(*[F.array(*map(F.lit, row)) for row in rows]), F.greatest(full, F.lit(1)))
    return F.when(full == 0, 0).otherwise((full - 1) * width + count(inner))


def edited_fingerprints(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint each text and its edit by the next text, next in ascending id and the first after the last.

    The edit replaces the last floor(n/2) code points by as many of the next text's first ones (or all it has). Rows
    with one id follow each other by the hash of their text. The table is dealt into ranges of ids, so the next text is
    met in the same sorted task; only the first row of each range also goes to the range before it. Texts move through
    one shuffle, and no task holds more than one batch and one row.
    """
    small_batches(spark)
    pieces = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)))
    bounds = _bounds(df.select(key.alias("key")), pieces)
    source = df.select(
        F.col(id_col).cast("long").alias("id"), key.alias("key"), F.coalesce(text_col, F.lit("")).alias("text"))
    source = source.withColumn("piece", _piece(F.col("key"), bounds).cast("int"))
    heads = [row["key"] for row in df.select(key.alias("key")).withColumn(
        "piece", _piece(F.col("key"), bounds)).groupBy("piece").agg(F.min("key").alias("key")).collect()]
    first = source.where(F.col("key").isin(heads)).groupBy("piece").agg(F.min_by(
        F.struct("id", "key", "text"), F.struct(F.xxhash64("text"), "text")).alias("row"))
    places = sorted(first.select("piece").distinct().toPandas()["piece"]) if heads else []
    before = F.element_at(F.create_map(*[
        F.lit(int(x)) for here, back in zip(places, [places[-1], *places[:-1]]) for x in (here, back)
    ]), F.col("piece")) if places else F.lit(0)
    tails = first.select("row.*", before.cast("int").alias("piece"), F.lit(1).alias("tail"))
    rows = source.withColumn("tail", F.lit(0)).unionByName(tails)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "piece").sortWithinPartitions(
        "piece", "tail", "key", F.xxhash64("text"), "text").select("piece", "tail", "id", "text")
    schema = (
        "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double")
    return dealt.mapInArrow(_edits, schema)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None  # the row whose next text is still to come: piece, id, text, signature
    for batch in batches:
        for start, stop in slices(batch.column(3)):
            part = batch.slice(start, stop - start)
            piece, tail, ids, texts = (column.to_pylist() for column in part.columns)
            own = signatures(part.column(3))
            rows = [] if last is None else [last]
            rows += [(piece[k], tail[k], ids[k], texts[k], own[k]) for k in range(len(ids))]
            last = rows[-1]
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1]]
            if pairs:
                yield _edit_rows(pairs)


def _edit_rows(pairs: list) -> pa.RecordBatch:
    edits = [x[3][: len(x[3]) - len(x[3]) // 2] + y[3][: len(x[3]) // 2] for x, y in pairs]
    own, following = np.array([x[4] for x, _ in pairs]), np.array([y[4] for _, y in pairs])
    edited = signatures(pa.array(edits, pa.large_string()))
    return pa.RecordBatch.from_arrays([
        pa.array([x[2] for x, _ in pairs], pa.int64()), pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edits]), pa.array(fingerprint_text(own)),
        pa.array(fingerprint_text(edited)), pa.array(likeness(own, edited)), pa.array(likeness(own, following)),
    ], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
