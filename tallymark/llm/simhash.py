"""SimHash near-duplicates by covering locality-sensitive hashing.

Words are runs of anything but ASCII white space with A-Z in lower case; shingles are three words joined by spaces,
repeats included (fewer words: the whole sequence). A fingerprint bit is 1 if it is set in over half of the shingles'
XXH64 values (seed 42). Fingerprints that differ in at most ``radius`` bits are linked.

Every bit position gets a random vector of radius + 1 bits; each non-zero vector v gives one mask, which holds the
positions whose vector has an odd product with v. The positions in which two fingerprints within the radius differ span
at most ``radius`` dimensions, so some v is orthogonal to all of them: under that mask both fingerprints are equal. All
2**(radius + 1) - 1 masks together therefore find every pair, not just most (a covering family).

Equal fingerprints are one node, so copies are never compared. In a group of fingerprints equal under a mask, up to
``SMALL`` members are compared pair by pair. A larger group is resolved exactly without pairs: two values are within an even radius
r just if some value lies within r / 2 of both, so each member is dealt to all values within r / 2 (differing outside
the mask) and all members that meet there are linked to the smallest. Both ways lead to the same components.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and are linked like any other; repeated rows
share a component; rows with a null id keep their fingerprint and belong to the component of the same fingerprint, whose
name is null if no member has an id; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm.components import components
from tallymark.llm.minhash import copy_key
from tallymark.llm.words import small_batches
from tallymark.session import written

SHINGLE = 3
BITS = 64
RADIUS = 2
SMALL = 32
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_PART = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The SimHash of one text; shingles are hashed in parts, so a very long text needs no more memory for it."""
    import xxhash

    words = _WORD.findall((text or "").encode().translate(_LOWER))
    if not words:
        return 0
    digest, total, runs = xxhash.xxh64_digest, np.zeros(BITS, np.int64), max(1, len(words) - size + 1)
    for at in range(0, runs, _PART):
        some = b"".join([digest(b" ".join(words[k: k + size]), SEED) for k in range(at, min(at + _PART, runs))])
        bits = np.unpackbits(np.frombuffer(some, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > runs).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, **more) -> DataFrame:
    """``id``, ``bits`` (the 64 bits as a signed long) and the columns ``more``."""
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[c.alias(name) for name, c in more.items()])
    types, names = dict(source.dtypes), ["id", "bits", *more]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([fingerprint(t.as_py(), size) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits), *batch.columns[2:]], names)

    return source.mapInArrow(task, ", ".join(f"{name} {types.get(name, 'bigint')}" for name in names))


def covering_masks(radius: int = RADIUS, bits: int = BITS, seed: int = SEED) -> list[int]:
    """The masks as signed longs; any two values within the radius are equal under one of them."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), bits)
    masks = []
    for v in range(1, 1 << (radius + 1)):
        mask = sum(1 << k for k, x in enumerate(vectors) if bin(int(x) & v).count("1") % 2)
        masks.append(mask - (1 << bits) if mask >> (bits - 1) else mask)
    return masks


def _flips(mask: int, radius: int) -> list[int]:
    """All changes of up to ``radius`` bits outside the mask, as signed longs."""
    free = [k for k in range(BITS) if not mask >> k & 1]
    out = [sum(1 << k for k in some) for n in range(radius + 1) for some in combinations(free, n)]
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in out]


def links(spark: SparkSession, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a``, ``b``: enough links between distinct fingerprints (``node``, ``bits``) to join all that the radius joins."""
    if radius % 2:
        raise ValueError("the radius must be even")
    masks = covering_masks(radius)
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("bits").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)])
    dealt = nodes.select("node", "bits", F.explode(tables).alias("e")).select("node", "bits", "e.*")
    sizes = written(spark, dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    members = written(spark, dealt.join(sizes, ["t", "key"]), "members")

    small = members.where(F.col("n") <= SMALL).groupBy("t", "key").agg(
        F.array_sort(F.collect_list(F.struct("node", "bits"))).alias("m"))
    pairs = F.flatten(F.transform("m", lambda x: F.transform(
        F.filter("m", lambda y: (y["node"] > x["node"]) & (F.bit_count(x["bits"].bitwiseXOR(y["bits"])) <= radius)),
        lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))))
    found = small.select(F.explode(pairs).alias("p")).select("p.*")

    flips = F.array(*[F.array(*map(F.lit, _flips(m & (2**64 - 1), radius // 2))) for m in masks])
    large = members.where(F.col("n") > SMALL).select(
        "t", "key", "node", "bits", F.explode(F.element_at(flips, F.col("t") + 1)).alias("flip"),
    ).select("t", "key", "node", F.col("bits").bitwiseXOR(F.col("flip")).alias("middle"))
    heads = large.groupBy("t", "key", "middle").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = large.join(heads, ["t", "key", "middle"]).where("node <> head").select(
        F.col("head").alias("a"), F.col("node").alias("b"))
    return found.union(met).distinct()


def _labelled(spark: SparkSession, nodes: DataFrame, radius: int) -> DataFrame:
    """Add ``label``, common to a component, to the distinct ``bits`` of ``nodes``."""
    # Nodes are named by their fingerprint; what a component needs of its rows follows from its nodes.
    labels = components(spark, links(spark, nodes.select(F.col("bits").alias("node"), "bits"), radius))
    return nodes.join(labels.select(F.col("node").alias("bits"), "label"), "bits", "left").select(
        "bits", "low", F.coalesce("label", "bits").alias("label"))


def near_duplicates(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    size: int = SHINGLE,
) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hexadecimal digits), ``component_id`` (smallest id of the component)."""
    small_batches(spark)
    rows = written(spark, fingerprints(df, id_col, text_col, size), "fingerprints")
    nodes = written(spark, rows.groupBy("bits").agg(F.min("id").alias("low")), "nodes")
    named = _labelled(spark, nodes, radius)
    least = named.groupBy("label").agg(F.min("low").alias("component_id"))
    classes = named.join(least, "label").select("bits", "component_id")
    return rows.join(classes, "bits").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(
    spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS,
    size: int = SHINGLE,
) -> DataFrame:
    """``place`` (hash of the id) and ``copy`` (``copy_key`` of the text) of one row of each component: that of the smallest id, null ids
    last, then of the least copy."""
    small_batches(spark)
    rows = fingerprints(df, id_col, text_col, size, copy=copy_key(F.col(text_col)))
    row = F.struct(F.col("id").isNull().alias("no_id"), "id", "copy")
    nodes = written(spark, rows.groupBy("bits").agg(F.min(row).alias("low")), "nodes")
    least = _labelled(spark, nodes, radius).groupBy("label").agg(F.min("low").alias("row"))
    return least.select(F.xxhash64("row.id").alias("place"), "row.copy")
