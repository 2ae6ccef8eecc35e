"""Not-modified revisits: an as-of join by canonical URL to the latest earlier full response.

A capture is (record_id, url, time, status, headers, digest). A capture of status 304 holds no body; it is resolved by the
latest full response (status 200) of the same canonical URL that was captured before it. The revisit's validators must agree
with that response: its ``etag`` if it has one (weak comparison), else its ``last-modified``; a revisit without a validator, or whose validator
differs, stays unresolved and says why. A resolved revisit has the headers of the response, with the headers that a
304 may update taken from the revisit.

The join is two windows. A URL's captures are cut into 1024 time slots; within (url, slot) a running last value finds the response, and
one row per (url, slot) carries it on to later slots. So a URL with a third of all captures is spread over the slots,
and only record ids and headers move, never bodies.

Defined cases: captures with a null or empty url, or a null time, cannot be placed: a revisit among them is ``no-response``; of two
captures at one time the response with the smaller record id comes first, and a response counts as earlier only if its time is smaller;
repeated rows are resolved each; null headers are an empty map, header names are read in lower case; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.session import written

SLOTS = 1024
# Header fields that a not-modified answer may update (fixed by the HTTP caching rules).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Without scheme, ``www.``/``m.``/``blog.``-less host kept, default port, fragment, tracking parameters and end slash.

    Host in lower case, a leading ``www.`` dropped; ``utm_*``, ``ref`` and ``fbclid`` parameters dropped; empty queries dropped.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"(?s)#.*$", "")
    rest = F.regexp_replace(rest, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, r"^([^/?]*)", 1))
    host = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.regexp_replace(F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1), r"(^|&)(utm_[^&]*|ref=[^&]*|fbclid=[^&]*)", "")
    query = F.regexp_replace(query, r"^&+", "")
    return F.concat(host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))


def _lowered(headers: Column) -> Column:
    pairs = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    once = F.array_distinct(F.transform(pairs, lambda e: e["key"]))
    return F.map_from_entries(F.transform(once, lambda k: F.element_at(F.filter(pairs, lambda e: e["key"] == k), 1)))


def _strong(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolved(
    spark: SparkSession, df: DataFrame, record_id: str = "record_id", url: str = "url", time: str = "time", status: str = "status",
    headers: str = "headers", digest: str = "digest",
) -> DataFrame:
    """One row per revisit: ``record_id``, ``canonical_url``, ``response_id``, ``outcome``, ``digest``, ``headers``."""
    rows = df.select(
        F.col(record_id).alias("record_id"), canonical_url(F.col(url)).alias("canonical_url"), F.col(time).cast("long").alias("time"),
        F.col(status).alias("status"), F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")).alias("headers"),
        F.col(digest).alias("digest"))
    rows = rows.where("status IN (200, 304)").withColumn("headers", _lowered(F.col("headers")))
    rows = written(spark, rows, "captures")  # read several times below, without the bodies
    placed = (F.col("canonical_url") != "") & F.col("time").isNotNull()
    response = F.struct("record_id", "time", "digest", "headers")
    rows = rows.withColumn("response", F.when(placed & (F.col("status") == 200), response))
    loose = rows.where(~placed & (F.col("status") == 304)).withColumn("found", F.lit(None).cast(rows.schema["response"].dataType))

    span = rows.where(placed).agg(F.min("time").alias("low"), F.max("time").alias("high")).first()
    low, width = span["low"] or 0, max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // SLOTS))
    slot = F.floor((F.col("time") - low) / width).cast("int")
    slotted = rows.where(placed).withColumn("slot", slot)
    # At one time all revisits come before all responses: a response counts for later times only.
    order = ("time", F.col("status").desc(), "record_id")
    here = Window.partitionBy("canonical_url", "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = slotted.withColumn("inside", F.last("response", ignorenulls=True).over(here)).where("status = 304")
    last = slotted.where("status = 200").groupBy("canonical_url", "slot").agg(
        F.max_by("response", F.struct("time", "record_id")).alias("response"))
    empty = inside.select("canonical_url", "slot").distinct().withColumn(
        "response", F.lit(None).cast(rows.schema["response"].dataType))
    back = Window.partitionBy("canonical_url").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.unionByName(empty).groupBy("canonical_url", "slot").agg(F.first("response", ignorenulls=True).alias("response"))
    carried = carried.withColumn("earlier", F.last("response", ignorenulls=True).over(back)).where("earlier IS NOT NULL")
    joined = inside.join(carried.select("canonical_url", "slot", "earlier"), ["canonical_url", "slot"], "left")
    joined = joined.withColumn("found", F.coalesce("inside", "earlier"))

    columns = ["record_id", "canonical_url", "headers", "found"]
    both = joined.select(*columns).unionByName(loose.select(*columns))
    tag, date = F.col("headers")["etag"], F.col("headers")["last-modified"]
    theirs, their_date = F.col("found.headers")["etag"], F.col("found.headers")["last-modified"]
    outcome = (
        F.when(F.col("found").isNull(), "no-response")
        .when(tag.isNotNull(), F.when(_strong(tag) == _strong(theirs), "resolved").otherwise("etag-differs"))
        .when(date.isNotNull(), F.when(date == their_date, "resolved").otherwise("date-differs"))
        .otherwise("no-validator"))
    update = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    kept = F.map_filter(F.col("found.headers"), lambda k, v: ~F.array_contains(F.map_keys(update), k))
    good = F.col("outcome") == "resolved"
    return both.withColumn("outcome", outcome).select(
        "record_id", "canonical_url", F.when(F.col("outcome") != "no-response", F.col("found.record_id")).alias("response_id"), "outcome",
        F.when(good, F.col("found.digest")).alias("digest"), F.when(good, F.map_concat(kept, update)).alias("headers"))
