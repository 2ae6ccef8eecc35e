"""Mixing of sources to target weights by Efraimidis-Spirakis sampling, in column expressions only.

Every source has a target number of words: its weight's part of all words, stopped at ``CAP`` times what the source has; what is over is
shared again by weight among the others until none is above. The rounds of that run over the table of sources, and each is
two sums.

A target is first met by complete epochs: every document as often as the whole source fits. What is left of the target is drawn without
replacement: a document has the key -ln(u) / w, with u in (0, 1) out of a hash and w its quality weight, and the documents of least key
are taken until the words left are used up; the document at the border gives the words that are still missing, so a
source's words are its target rounded. Rows are dealt by range of source and key, one piece a partition: the words before a
document are those of its source's earlier pieces and those before it in its own piece, so a source with a third of all
documents has a third of all pieces. Rows that are equal in id, text, source and weight are one row with a count in all
this, and are dealt out again at the end.

Defined cases: a null or empty text has no words and gives none; null is the last source; weights that are null or NaN are 1, those of
zero or less are taken last, in an order of their own; repeated rows are kept and take part each; sources without words have target 0; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallymark.operators.skew import salted_lookup
from tallymark.session import written

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = 42
BLOCK = 1 << 16
LABEL_WEIGHTS = {"good": 4.0, "unlabelled": 2.0, "bad": 1.0}
_SPACE = r"\x20\x09-\x0D"


def word_count(text: Column) -> Column:
    """Runs of anything but ASCII white space, without a list of them: each becomes one letter, the spaces behind go."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), f"[{_SPACE}]*[^{_SPACE}]+", "x")
    return F.length(F.rtrim(marks, F.lit(" \t\n\x0b\f\r"))).cast("long")


def _text_key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def label_weights(df: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Add ``weight``: that of good documents (quality 1 and not toxic), of the other labelled ones and of those without a label. A document
    with several labels has the least of their weights; a label without a quality does not count."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias(id_col)).agg(
        F.min(F.when(good, F.lit(LABEL_WEIGHTS["good"])).otherwise(F.lit(LABEL_WEIGHTS["bad"]))).alias("_weight"))
    key = _text_key(F.col(id_col))  # never null, so rows without an id are dealt out as well
    found = salted_lookup(df.withColumn("_id", key), known.select(key.alias("_id"), "_weight"), "_id", "text_md5", "left")
    return found.withColumn("weight", F.coalesce("_weight", F.lit(LABEL_WEIGHTS["unlabelled"]))).drop("_weight", "_id")


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight: Column | None = None) -> DataFrame:
    """``doc_id``, ``source``, ``size``, ``text_md5`` and, if given, ``weight``: all that is read of the documents."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = [] if weight is None else [weight.cast("double").alias("weight")]
    return df.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(text).alias("size"),
        F.md5(text.cast("binary")).alias("text_md5"), *more)


def _above(left: int, shares: int) -> Column:
    """A source whose part of what is left would be more than its most, in whole numbers."""
    return F.col("most").cast("decimal(20,0)") * F.lit(shares).cast("decimal(17,0)") < F.col("w").cast("decimal(17,0)") * F.lit(left).cast("decimal(20,0)")


def source_targets(spark: SparkSession, rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``source``, ``source_size``, ``target``: one row per source.

    Sources are numbered in code-point order by range: each piece numbers its own, the pieces' sizes give the rest. A round fixes the
    sources at their cap and shares the rest among the others; only two sums and a count come to the driver.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranged = written(spark, sizes.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("_piece", F.spark_partition_id()), "sources")
    earlier = Window.partitionBy(F.lit(0)).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("_piece").agg(F.count(F.lit(1)).alias("_n")).select(
        "_piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # one row per range
    inside = Window.partitionBy("_piece").orderBy(F.col("source").asc_nulls_last())
    number = F.col("_before") + F.row_number().over(inside) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (number % len(weights) + 1).cast("int"))
    table = written(spark, ranged.join(F.broadcast(counts), "_piece").select(
        "source", "source_size", (F.col("source_size") * cap).alias("most"), weight.cast("long").alias("w")), "weighed")

    total = table.agg(F.sum("source_size")).first()[0] or 0
    left, shares, fixed = total, None, 0
    while True:
        # Above the cap, by the shares of the round before: fixed there. The first round fixes none.
        above = F.lit(False) if shares is None else _above(left, shares)
        row = table.agg(
            F.sum(F.when(above, F.col("most")).otherwise(F.lit(0))), F.sum(F.when(above, F.lit(0)).otherwise(F.col("w"))),
            F.count_if(above)).first()
        if shares is not None and row[2] == fixed:
            break
        left, shares, fixed = total - (row[0] or 0), row[1] or 0, row[2]
        if not shares:
            break
    share = F.col("w") * F.lit(left).cast("double") / F.lit(shares or 1).cast("double")
    capped = _above(left, shares or 0)
    return table.select("source", "source_size", F.when(capped, F.col("most").cast("double")).otherwise(share).alias("target"))


def exponential_key(weight: Column, *parts: Column | str) -> Column:
    """-ln(u) / w, with u out of 52 bits of a hash: the smaller, the earlier. A weight of zero or less counts as 1; those rows are
    ranked behind all others."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long") + 0.5) / F.lit(float(1 << 52))
    return -F.log(u) / F.when(weight > 0, weight).otherwise(F.lit(1.0))


def mixed(spark: SparkSession, rows: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP, seed: int = SEED) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target``, ``taken``, ``source``, ``epochs`` for all ``rows`` (of ``measured``; without
    a ``weight`` all weigh the same)."""
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
    weight = F.when(weight.isNull() | F.isnan(weight), F.lit(1.0)).otherwise(weight).alias("weight")
    rows = written(spark, rows.select("doc_id", "source", "size", "text_md5", weight), "rows")
    targets = written(spark, source_targets(spark, rows, weights, cap), "targets")
    same = ["doc_id", "source", "size", "text_md5", "weight"]
    ids = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    keyed = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")).select(
        "*", _text_key(F.col("source")).alias("source_key"), (F.col("weight") <= 0).alias("late"),
        exponential_key(F.col("weight"), F.lit(str(seed)), ids, F.col("text_md5")).alias("key"))
    order = ["late", "key", "doc_id", "text_md5", "size", "weight"]
    keyed = written(spark, keyed.repartitionByRange("source_key", *order).withColumn("piece", F.spark_partition_id()), "keyed")

    words = F.col("size") * F.col("copies")
    earlier = Window.partitionBy("source_key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("source_key", "piece").agg(F.sum(words).alias("_n")).select(
        "source_key", "piece", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))  # a source has a row per range
    inside = Window.partitionBy("source_key", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0))).join(before, ["source_key", "piece"])
    known = targets.select(
        _text_key(F.col("source")).alias("source_key"), "source_size", "target", F.round("target").cast("long").alias("_budget"))
    placed = salted_lookup(placed, known, "source_key", "text_md5", "inner")
    # A row of very many copies is dealt over the tasks in blocks before they become rows again.
    placed = placed.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK)))) \
        .repartition("text_md5", "doc_id", "_block")
    last = F.least(F.col("copies"), (F.col("_block") + 1) * BLOCK) - 1
    single = placed.withColumn("_copy", F.explode(F.sequence(F.col("_block") * BLOCK, last)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("_budget") - epochs * F.col("source_size")
    drawn = F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("_before") - F.col("_inside") - F.col("_copy") * F.col("size")))
    return single.select(
        "doc_id", "size", "source_size", "target", (epochs * F.col("size") + drawn).cast("long").alias("taken"), "source",
        epochs.alias("epochs"))
