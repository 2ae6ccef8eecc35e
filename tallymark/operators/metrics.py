"""Classification metrics from confusion counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.answers import is_positive
from tallymark.functions.text import as_percent
from tallymark.operators.skew import salted_lookup

# Metric names of the long table, and report rows with the metric each one shows.
METRICS = (
    "accuracy", "macro-f1", "micro-f1", "macro-precision", "micro-precision", "macro-recall", "micro-recall",
    "matthews_corrcoef",
)
REPORT_ROWS = (
    ("ACC", "accuracy"), ("Macro-F1", "macro-f1"), ("Micro-F1", "micro-f1"), ("Macro-P", "macro-precision"),
    ("Micro-P", "micro-precision"), ("Macro-R", "macro-recall"), ("Micro-R", "micro-recall"),
    ("MCC", "matthews_corrcoef"),
)
COMPAT_RECALL = {"Macro-R": "macro-precision", "Micro-R": "macro-precision"}


def confusion(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per true and predicted class; all that the metrics need, and small after the partial aggregate."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def class_counts(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per class: rows of that truth, rows of that prediction, rows of both."""
    hit = F.when(F.col("truth").eqNullSafe(F.col("predicted")), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p"),
                 hit.cast("long").alias("tp")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"),
                 F.lit(0).cast("long").alias("tp")),
    )
    return counts.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.class").agg(
        F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum("s.tp").alias("tp")
    )


def _ratio(part, whole):
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def wide_metrics(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per group with a column per metric.

    Macro means run over the classes seen in truth or prediction. With one label per row, micro precision, recall and
    F1 all equal the accuracy.
    """
    per_class = class_counts(confusion(df, truth, predicted, by), by)
    t, p, tp = (F.col(c).cast("double") for c in ("t", "p", "tp"))
    precision, recall = _ratio(tp, p), _ratio(tp, t)
    f1 = _ratio(tp * 2, t + p)
    sums = per_class.groupBy(*by).agg(
        F.sum(t).alias("s"), F.sum(tp).alias("c"), F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"),
        F.sum(t * t).alias("tt"), F.avg(precision).alias("macro-precision"), F.avg(recall).alias("macro-recall"),
        F.avg(f1).alias("macro-f1"),
    )
    s, c, pt, pp, tt = (F.col(x) for x in ("s", "c", "pt", "pp", "tt"))
    micro = _ratio(c, s)
    spread = F.sqrt((s * s - pp) * (s * s - tt))
    values = {
        "accuracy": micro, "micro-f1": micro, "micro-precision": micro, "micro-recall": micro,
        "matthews_corrcoef": _ratio(c * s - pt, spread),
    }
    return sums.select(*by, *[values.get(m, F.col(f"`{m}`")).alias(m) for m in METRICS])


def long_metrics(wide: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """From one column per metric to one row per metric."""
    return wide.unpivot(list(by), [f"`{m}`" for m in METRICS], "metric", "score")


def macro_f1(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """The one number a model is chosen by."""
    return wide_metrics(df, truth, predicted).select(F.col("`macro-f1`").alias("macro_f1"))


def report(df: DataFrame, truth: str, predicted: str, by: tuple[str, ...] = (), compat: bool = False) -> DataFrame:
    """Metrics as percent under their report names: ``by``, ``Metric``, ``score``.

    ``compat`` shows the macro precision in both recall rows, as older tables did.
    """
    shown = COMPAT_RECALL if compat else {}
    rows = F.array(*[
        F.struct(F.lit(name).alias("Metric"), as_percent(F.col(f"`{shown.get(name, m)}`")).alias("score"))
        for name, m in REPORT_ROWS
    ])
    return wide_metrics(df, truth, predicted, by).select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def with_scopes(df: DataFrame, splits: DataFrame, key: str = "filename", spread_by: str = "row_idx") -> DataFrame:
    """One row per report scope: All, and Validation or Test when the key occurs in that split.

    Splits are made by text but matched by ``key``, so a file name that occurs in both splits counts in both.
    """
    seen = splits.groupBy(key).agg(
        F.max((F.col("split") == "validation").cast("int")).alias("_validation"),
        F.max((F.col("split") == "test").cast("int")).alias("_test"),
    )
    marked = salted_lookup(df, seen, key, spread_by, "left")
    scopes = F.array_compact(F.array(
        F.lit("All"), F.when(F.col("_validation") == 1, F.lit("Validation")), F.when(F.col("_test") == 1, F.lit("Test"))
    ))
    return marked.withColumn("scope", F.explode(scopes)).drop("_validation", "_test")


def rows_of_split(
    df: DataFrame, splits: DataFrame, split: str, key: str = "filename", spread_by: str = "row_idx",
) -> DataFrame:
    """Rows whose key occurs in a split."""
    keys = splits.where(F.col("split") == split).select(key).distinct()
    return salted_lookup(df, keys, key, spread_by, "left_semi")


def binary_report(
    df: DataFrame, splits: DataFrame, truth: str = "label", predicted: str = "label_predicted",
    key: str = "filename", spread_by: str = "row_idx", compat: bool = False,
) -> DataFrame:
    """``Metric, Validation, Test, All`` in percent for presence detection."""
    binary = with_scopes(df, splits, key, spread_by).select(
        "scope", is_positive(F.col(truth)).alias("_t"), is_positive(F.col(predicted)).alias("_p")
    )
    scopes = ["Validation", "Test", "All"]
    return report(binary, "_t", "_p", ("scope",), compat).groupBy("Metric").pivot("scope", scopes).agg(F.first("score"))


def side_by_side(validation: DataFrame, test: DataFrame) -> DataFrame:
    """``Metric, Validation, Test`` in percent, matched by metric name."""
    return validation.select(F.col("metric").alias("Metric"), as_percent(F.col("score")).alias("Validation")).join(
        test.select(F.col("metric").alias("Metric"), as_percent(F.col("score")).alias("Test")), "Metric"
    )
