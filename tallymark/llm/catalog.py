"""Registered queries of the training-data operators: name -> function of a session and a folder of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.llm import (
    decontaminate, hmm, licenses, minhash, mixing, packing, quality, revisits, sharding, simhash, spelling, urls, vectors,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_fingerprints(spark, sf):
    """MinHash fingerprints of all texts and of their edits by the next text."""
    return minhash.edited_fingerprints(spark, _table(spark, sf, "documents"))


@query
def op2_licenses(spark, sf):
    """License phrases and templates in every document."""
    return licenses.scanned(_table(spark, sf, "documents")).drop("spans")


@query
def op3_decontamination(spark, sf):
    """Every benchmark item that a document contains."""
    return decontaminate.contaminated(spark, _table(spark, sf, "documents"), _table(spark, sf, "benchmark"))


@query
def op4_quality(spark, sf):
    """Posterior quality of every document."""
    return quality.judged(spark, _table(spark, sf, "documents"), _table(spark, sf, "labels"))


@query
def op5_hmm_scores(spark, sf):
    """Unigram and hidden Markov scores of every document."""
    return hmm.scored(spark, _table(spark, sf, "documents"))


@query
def op6_feistel_shards(spark, sf):
    """All documents dealt over 40 shards by a keyed permutation of their row numbers."""
    return sharding.sharded(_table(spark, sf, "documents"))


@query
def op7_url_filter(spark, sf):
    """Rule and verdict of every page url."""
    return urls.judged(_table(spark, sf, "pages"))


# Captures out of the pages: each page is a full response at time 10 * page_id, and is asked for again later, with a
# validator that is the page's own, an old one, a date or none. Both engines read this text the same way.
CAPTURES_SQL = """
SELECT page_id * 2 AS record_id, url, page_id * 10 AS time, 200 AS status, md5(html) AS digest,
  concat('"', substr(md5(html), 1, 8), '"') AS etag, concat('day ', CAST(page_id % 28 AS STRING)) AS modified,
  'text/html' AS kind, concat('first ', CAST(page_id AS STRING)) AS date
FROM pages
UNION ALL
SELECT page_id * 2 + 1, url, page_id * 10 + 3 + page_id % 7 * 1000, 304, CAST(NULL AS STRING),
  CASE page_id % 5 WHEN 0 THEN '"old"' WHEN 1 THEN NULL WHEN 2 THEN NULL
    ELSE concat('W/"', substr(md5(html), 1, 8), '"') END,
  CASE page_id % 5 WHEN 1 THEN concat('day ', CAST(page_id % 28 AS STRING)) ELSE NULL END,
  'text/plain', concat('again ', CAST(page_id AS STRING))
FROM pages
"""


@query
def op9_revisits(spark, sf):
    """Every not-modified capture with the response it stands for."""
    captures = spark.sql(CAPTURES_SQL.replace("FROM pages", "FROM {pages}"), pages=_table(spark, sf, "pages"))
    headers = F.map_filter(F.create_map(
        F.lit("ETag"), "etag", F.lit("Last-Modified"), "modified", F.lit("Content-Type"), "kind", F.lit("Date"), "date",
    ), lambda k, v: v.isNotNull())
    found = revisits.resolved(spark, captures.select("record_id", "url", "time", "status", "digest", headers.alias("headers")))
    merged = F.array_join(F.array_sort(F.transform(
        F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "; ")
    return found.withColumn("headers", merged)


@query
def op8_simhash(spark, sf):
    """SimHash fingerprints and the components of those within two bits."""
    return simhash.near_duplicates(spark, _table(spark, sf, "documents"))


@query
def op10_packing(spark, sf):
    """Every document's pieces with their place in sequences of 1024 tokens."""
    return packing.packed(spark, _table(spark, sf, "documents"))


@query
def op11_spelling(spark, sf):
    """Every word of the corpus with its near words and the form it is a variant of."""
    return spelling.variants(spark, _table(spark, sf, "documents"))


@query
def op12_codes(spark, sf):
    """Product codes of every whole vector."""
    return vectors.compressed(spark, _table(spark, sf, "embeddings"))


@query
def op13_mixing(spark, sf):
    """How many words of every document the mix takes; documents labelled good are drawn first more often."""
    rows = mixing.label_weights(mixing.measured(_table(spark, sf, "documents")), _table(spark, sf, "labels"))
    return mixing.mixed(spark, rows)
