"""Scores of predicted records against annotated ones, for lists in a column and for records in rows."""

from __future__ import annotations

from collections import Counter
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark.fixed import FIELDS, MATCH_FIELDS
from tallymark.functions.records import empty_records, field_values, match_keys, records_text, view_records, view_text, view_values
from tallymark.functions.scores import scores_from_counts, set_counts


def with_scores(
    df: DataFrame, truth: str = "y_true", predicted: str = "y_pred", fields: tuple[str, ...] = MATCH_FIELDS,
) -> DataFrame:
    """Add ``key_value_eval`` (whole records) and ``span_scores`` (field by field).

    An answer that could not be parsed counts as no records. ``span_scores`` is a struct by field, so that a report
    which reads one score of one field reads only that column from a stored table.
    """
    t, p = (F.coalesce(F.col(c), empty_records()) for c in (truth, predicted))
    views = {"_records": lambda c: match_keys(c, fields), **{f"_{f}": partial(field_values, field=f) for f in fields}}
    keys = [F.array_distinct(make(c)).alias(f"{n}{side}") for n, make in views.items() for side, c in (("_t", t), ("_p", p))]
    keyed = df.select("*", *keys)
    counted = keyed.select(*df.columns, *[set_counts(F.col(f"{n}_t"), F.col(f"{n}_p")).alias(n) for n in views])
    return counted.select(
        *df.columns, scores_from_counts("_records").alias("key_value_eval"),
        F.struct(*[scores_from_counts(f"_{f}").alias(f) for f in fields]).alias("span_scores"),
    )


def with_texts(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Add both record lists as sorted sentences; an answer that could not be parsed gives an empty text."""
    return df.withColumn("y_true_as_string", F.coalesce(records_text(F.col(truth)), F.lit(""))).withColumn(
        "y_pred_as_string", F.coalesce(records_text(F.col(predicted)), F.lit(""))
    )


def with_field_views(df: DataFrame, truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """One row per view: all fields (``None``), then each field alone, with the record texts of that view."""
    sides = (("y_true", F.col(truth)), ("y_pred", F.col(predicted)))
    rest = [c for c in df.columns if c not in (truth, predicted)]
    # Steps that Spark compiles, while it would interpret them inside the generator: the values of every field, the views made of them, the rows.
    listed = df.select(*rest, *[c.alias(f"_{n}") for n, c in sides],
                       *[view_values(c, f).alias(f"_{n}_{f}") for n, c in sides for f in FIELDS])
    whole = {n: (F.col(f"_{n}"), records_text(F.col(f"_{n}"))) for n, _ in sides}
    single = {f: {n: (view_records(F.col(f"_{n}_{f}"), f), view_text(F.col(f"_{n}_{f}"), f)) for n, _ in sides} for f in FIELDS}
    made = listed.select(*rest, *[
        F.struct(F.lit(name).alias("label_view"), *[made.alias(n) for n, (made, _) in view.items()],
                 *[F.coalesce(text, F.lit("")).alias(f"{n}_as_string") for n, (_, text) in view.items()]).alias(f"_v_{name}")
        for name, view in {"None": whole, **single}.items()
    ])
    return made.select(*rest, F.explode(F.array(*[f"_v_{name}" for name in ("None", *FIELDS)])).alias("_v")).select(*rest, "_v.*")


def key_rows(df: DataFrame, page: str, truth: Column, predicted: Column) -> DataFrame:
    """From one annotated and one predicted key per row (null where there is none) to rows for ``long_scores``."""
    sides = F.array(
        F.struct(truth.alias("key"), F.lit(1).alias("t"), F.lit(0).alias("p")),
        F.struct(predicted.alias("key"), F.lit(0).alias("t"), F.lit(1).alias("p")),
    )
    rows = df.select(page, F.explode(sides).alias("_s")).select(page, "_s.*")
    return rows.where(F.col("key").isNotNull())


def long_scores(pages: DataFrame, keys: DataFrame, page: str, key: str = "key") -> DataFrame:
    """Set scores per page when records lie in rows of their own: the columns of ``pages`` and ``score``.

    ``keys`` has a row per page and record key with flags ``t`` (annotated) and ``p`` (predicted). Both aggregates
    combine before their shuffle and the first one spreads by page and key, so a page with a very large number of
    records is never gathered in one place. Pages without any record score 1.
    """
    labels = keys.groupBy(page, key).agg(F.max("t").alias("t"), F.max("p").alias("p"))
    counts = labels.groupBy(page).agg(
        F.sum("t").alias("a"), F.sum("p").alias("b"), F.sum(F.col("t") * F.col("p")).alias("i")
    )
    filled = pages.join(counts, page, "left").select(
        *pages.columns, F.struct(*[F.coalesce(F.col(n), F.lit(0)).alias(n) for n in "abi"]).alias("_counts")
    )
    return filled.select(*pages.columns, scores_from_counts("_counts").alias("score"))


def rouge1(df: DataFrame, row: str, reference: str, candidate: str) -> DataFrame:
    """Unigram overlap F1, precision and recall per row: a step on the row, without a shuffle."""
    split = df.select(row, tokens(F.col(reference)).alias("_r"), tokens(F.col(candidate)).alias("_c"))
    return _overlap_f1(split.select(
        row, F.size("_r").alias("n_ref"), F.size("_c").alias("n_cand"), _common_tokens("_r", "_c").alias("hits")))


def tokens(text):
    """Lower-case runs of ASCII letters and digits; a null text has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: t != "")


def _overlap_f1(df: DataFrame) -> DataFrame:
    precision = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n_cand").cast("double")), F.lit(0.0))
    recall = F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("n_ref").cast("double")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(precision * recall * 2, precision + recall), F.lit(0.0))
    return df.select(
        *[c for c in df.columns if c not in ("n_ref", "n_cand", "hits")],
        precision.alias("precision"), recall.alias("recall"), f1.alias("f1"),
    )


@F.pandas_udf(T.IntegerType())
def _common_tokens(reference, candidate):
    import pandas as pd

    return pd.Series([(Counter(a) & Counter(b)).total() for a, b in zip(reference, candidate)], dtype="int32")


@F.pandas_udf(T.IntegerType())
def _common_length(reference, candidate):
    import pandas as pd

    return pd.Series([_lcs(a, b) for a, b in zip(reference, candidate)], dtype="int32")


def _lcs(a, b) -> int:
    """Length of the longest common subsequence, one machine word of ``b`` at a time."""
    where: dict[str, int] = {}
    for position, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << position)
    full = (1 << len(b)) - 1
    state = full
    for token in a:
        hit = state & where.get(token, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(b) - state.bit_count()


def rouge_l(df: DataFrame, row: str, reference: str, candidate: str) -> DataFrame:
    """Longest common token sequence F1, precision and recall per row."""
    split = df.select(row, tokens(F.col(reference)).alias("_r"), tokens(F.col(candidate)).alias("_c"))
    return _overlap_f1(split.select(
        row, F.size("_r").alias("n_ref"), F.size("_c").alias("n_cand"), _common_length("_r", "_c").alias("hits")
    ))
