"""Inputs of the registered queries, derived from the test tables.

The texts below are plain SQL that both engines read the same way. They only lay out inputs: annotated pages, model
answers and labels. What is tested (cleaning, parsing, scoring, reporting) is never part of them.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.records import normalized

# One row of lineitem is one page with up to three annotated records and one model answer. Nothing is grouped.
PAGES_SQL = """
WITH base AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
    CASE WHEN l_partkey % 23 = 0 THEN NULL
         WHEN l_returnflag IN ('A', 'R') THEN 'has_criteria' ELSE 'has_no_criteria' END AS label,
    (l_partkey * 7 + l_suppkey) % 16 AS style,
    concat('ZK ', CAST(l_linenumber AS STRING)) AS zk1,
    concat('ZK ', CAST(l_linenumber + 1 AS STRING)) AS zk2,
    concat('Preis ', l_returnflag, l_linestatus) AS kr1,
    concat('Qua-', chr(10), 'lität ', CAST(l_partkey % 50 AS STRING)) AS kr2,
    concat(CAST(CAST(round(l_discount * 100) AS INT) AS STRING), '%') AS ge1,
    CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE '30%' END AS ge2,
    CAST(CAST(l_quantity AS INT) AS STRING) AS mp1
  FROM lineitem
), flags AS (
  SELECT *,
    coalesce(label, 'x') <> 'has_no_criteria' AS t1,
    coalesce(label, 'x') <> 'has_no_criteria' AND l_suppkey % 3 <> 0 AS t2,
    coalesce(label, 'x') <> 'has_no_criteria' AND l_suppkey % 5 = 0 AS t3,
    coalesce(label, 'x') <> 'has_no_criteria' AND l_partkey % 5 <> 0 AS p1,
    coalesce(label, 'x') <> 'has_no_criteria' AND l_suppkey % 3 <> 0 AND l_partkey % 6 <> 0 AS p2,
    l_partkey % 9 = 0 AS p3,
    CASE WHEN l_suppkey % 7 = 0 THEN 'Preis X' ELSE kr1 END AS pkr1
  FROM base
), listed AS (
  SELECT *, concat('[', concat_ws(', ',
    CASE WHEN p1 THEN concat('{"zkNummer": "', zk1, '", "kriterium": "', pkr1, '", "gewichtung": "', ge1,
                             '", "maxPunkte": "', mp1, '"}') END,
    CASE WHEN p2 THEN concat('{"zkNummer": "', zk2, '", "kriterium": "', kr2, '", ',
                             CASE WHEN ge2 IS NULL THEN '' ELSE concat('"gewichtung": "', ge2, '", ') END,
                             '"maxPunkte": null}') END,
    CASE WHEN p3 THEN '{"kriterium": "Zusatz"}' END), ']') AS list_text
  FROM flags
)
SELECT *,
  concat(CAST(l_orderkey AS STRING), '_', CAST(l_linenumber AS STRING), '.txt') AS filename,
  concat('prompt_', CAST(1 + l_partkey % 4 AS STRING)) AS prompt_id,
  CASE WHEN (label = 'has_criteria') = (l_suppkey % 10 >= 2) THEN 'has_criteria' ELSE 'has_no_criteria' END
    AS label_predicted,
  CASE style
    WHEN 0 THEN concat('```json', chr(10), list_text, chr(10), '```')
    WHEN 1 THEN concat('Hier die Liste: ', replace(list_text, '"', chr(39)), ' Ende')
    WHEN 2 THEN concat('[', list_text, ' ]')
    WHEN 3 THEN concat(list_text, ' und [{"kriterium": "B"}]')
    WHEN 4 THEN 'Nein.'
    WHEN 5 THEN replace(list_text, '}]', '},]')
    WHEN 6 THEN '[{"kriterium": "Zahl", "maxPunkte": 30.0}]'
    WHEN 7 THEN replace(list_text, '[{', '[1, "x", {')
    WHEN 8 THEN '[{"kriterium": true}]'
    WHEN 9 THEN '[{}]'
    WHEN 10 THEN '{"kriterium": "A"}'
    WHEN 11 THEN '[{"kriterium": "A [x]"}]'
    ELSE list_text END AS answer
FROM listed
"""

# One document with a label is one labelled text; some labels are unsure, some missing, some file names shared.
TEXTS_SQL = """
SELECT d.doc_id, d.text, concat(d.source, '_', CAST(d.doc_id % 97 AS STRING), '.txt') AS filename,
  CASE WHEN d.doc_id % 19 = 0 THEN NULL
       ELSE concat(CASE WHEN l.quality = 1 THEN 'has_criteria' ELSE 'has_no_criteria' END,
                   CASE WHEN d.doc_id % 17 = 0 THEN '?' ELSE '' END) END AS label,
  CASE WHEN (l.quality = 1) = (d.doc_id % 10 >= 2) THEN 'has_criteria' ELSE 'has_no_criteria' END AS label_predicted
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

# One line of an order is one annotated record of that order, and maybe one predicted record.
LINES_SQL = """
SELECT l_orderkey,
  concat('ZK', CAST(l_linenumber AS STRING)) AS zk,
  concat(l_returnflag, l_linestatus) AS kr,
  concat(CAST(CAST(round(l_discount * 100) AS INT) AS STRING), '%') AS ge,
  CAST(CAST(l_quantity AS INT) AS STRING) AS mp,
  l_partkey % 5 <> 0 AS predicted,
  CASE WHEN l_suppkey % 7 = 0 THEN 'X' ELSE concat(l_returnflag, l_linestatus) END AS pkr,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE concat(CAST(CAST(round(l_discount * 100) AS INT) AS STRING), '%') END
    AS pge
FROM lineitem
"""
ORDERS_SQL = """
SELECT o_orderkey AS l_orderkey, concat('prompt_', CAST(1 + o_custkey % 4 AS STRING)) AS prompt_id,
  CASE o_orderstatus WHEN 'F' THEN 'has_criteria' WHEN 'O' THEN 'has_no_criteria' END AS label
FROM orders
"""

# One assistant turn is one answer to a yes/no question.
ANSWERS_SQL = """
SELECT conv_id, turn, concat(
  CASE conv_id % 3 WHEN 0 THEN '  Ja, ' WHEN 1 THEN concat(chr(10), 'NEIN. ') ELSE '' END, text) AS answer
FROM conversations WHERE role = 'assistant'
"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A test table. ``spark.tallymark.inputPartitions`` deals its rows over so many partitions; off unless set.

    A one-file table is one task whatever the number of cores, so the bench sets it and prints it.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get("spark.tallymark.inputPartitions", None)
    return df.repartition(int(parts)) if parts else df


def _select(spark: SparkSession, sf: str, sql: str) -> DataFrame:
    """Run one of the texts above over the tables of a folder."""
    names = set(re.findall(r"\b(?:FROM|JOIN) (lineitem|orders|documents|labels|conversations)\b", sql))
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(names)})\b", r"\1 {\2}", sql.replace("{", "{{").replace("}", "}}"))
    return spark.sql(text, **{name: table(spark, sf, name) for name in names})


def _record(**values: Column | str) -> Column:
    return F.create_map(*[
        part for key, value in values.items()
        for part in (F.lit(key), F.lit(value) if isinstance(value, str) else value)
    ])


def pages(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated pages with raw ``criteria_info`` and the model's raw answer."""
    df = _select(spark, sf, PAGES_SQL)
    second = _record(zkNummer=F.col("zk2"), kriterium=F.col("kr2"), gewichtung=F.col("ge2"), maxPunkte="")
    second = F.map_filter(second, lambda k, v: v.isNotNull())
    truth = F.array(
        F.when(F.col("t1"), _record(
            zkNummer=F.col("zk1"), kriterium=F.col("kr1"), gewichtung=F.col("ge1"), maxPunkte=F.col("mp1"))),
        F.when(F.col("t2"), second),
        F.when(F.col("t3"), _record(zkNummer="", kriterium="")),
    )
    return df.select(
        *PAGE_KEY, "filename", "label", "label_predicted", "prompt_id", "list_text",
        F.col("answer").alias("pred_output_as_string"), F.array_compact(truth).alias("criteria_info"),
    )


PAGE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def with_truth(df: DataFrame) -> DataFrame:
    """The annotated records as they are scored."""
    return df.withColumn("y_true", normalized(F.col("criteria_info")))


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled texts; ``row_idx`` is the document number."""
    return _select(spark, sf, TEXTS_SQL).withColumnRenamed("doc_id", "row_idx")


def answers(spark: SparkSession, sf: str) -> DataFrame:
    return _select(spark, sf, ANSWERS_SQL)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return _select(spark, sf, ORDERS_SQL)


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Annotated and predicted records in rows of their own, as maps."""
    df = _select(spark, sf, LINES_SQL)
    truth = _record(zkNummer=F.col("zk"), kriterium=F.col("kr"), gewichtung=F.col("ge"), maxPunkte=F.col("mp"))
    found = _record(zkNummer=F.col("zk"), kriterium=F.col("pkr"), gewichtung=F.col("pge"), maxPunkte=F.col("mp"))
    return df.select(
        "l_orderkey", truth.alias("truth"),
        F.when(F.col("predicted"), F.map_filter(found, lambda k, v: v.isNotNull())).alias("found"),
    )
