"""Classifiers in closed form: naive Bayes heads that are trained by one grouped aggregation.

A text model counts hashed words by class (multinomial), a vector model takes means and variances by class and place (normal). Both
read the training rows once, and counts are combined before the shuffle, so a class with most of the rows is no hot key. A model is two
small tables: one row per class, and one row per class and feature or place. Its size is bounded by the number of
features or places times that of classes, whatever the number of rows, which is why prediction may broadcast it: rows become
(row, feature) pairs only inside their task, and one sum per class and row leaves it.

Defined cases: null and empty texts have no words and get the class of most training rows; a null, NaN or missing component of a
vector says nothing, as does one at a place that a class never had; rows without a label are not trained on; equal scores give
the first class in sorted order; without training rows no row gets a class.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallymark.functions.answers import best_class
from tallymark.operators.scoring import tokens
from tallymark.session import written

DIGITS = 4
ALPHA = 1.0
LEAST_VARIANCE = 1e-9
MOST_CLASSES = 1000


@dataclass
class BayesModel:
    """``classes``: ``label``, ``rows``, ``prior`` and, of a text model, ``total`` words and the weight ``unseen`` of a word the class never
    had. ``features``: ``label``, ``feature`` and what the class knows about it."""

    kind: str
    classes: DataFrame
    features: DataFrame

    def save(self, path: str) -> None:
        self.classes.withColumn("kind", F.lit(self.kind)).write.mode("overwrite").parquet(f"{path}/classes")
        self.features.write.mode("overwrite").parquet(f"{path}/features")

    @staticmethod
    def load(spark: SparkSession, path: str) -> BayesModel:
        classes = spark.read.parquet(f"{path}/classes")
        first = classes.select("kind").first()
        return BayesModel(first[0] if first else "text", classes.drop("kind"), spark.read.parquet(f"{path}/features"))


def hashed_word(word: Column, digits: int = DIGITS) -> Column:
    """The feature of a word: the first hexadecimal digits of its hash, so there are 16 ** digits features."""
    return F.substring(F.md5(word.cast("binary")), 1, digits)


def _priors(rows: DataFrame) -> DataFrame:
    """``label``, ``rows`` and the log share of a class; the classes are few."""
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows").alias("_all"))
    return counts.join(F.broadcast(total)).select("label", "rows", F.log(F.col("rows") / F.col("_all")).alias("prior"))


def train_texts(
    spark: SparkSession, df: DataFrame, text: str = "text", label: str = "label", digits: int = DIGITS, alpha: float = ALPHA,
) -> BayesModel:
    """Multinomial naive Bayes over hashed words, smoothed by ``alpha`` for each of the 16 ** digits features."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(text).alias("_text"))
    words = rows.select("label", F.explode(tokens(F.col("_text"))).alias("_w"))
    counts = written(spark, words.groupBy("label", hashed_word(F.col("_w"), digits).alias("feature")).agg(F.count(F.lit(1)).alias("n")), "word-counts")
    totals = counts.groupBy("label").agg(F.sum("n").alias("total"))
    room = F.coalesce("total", F.lit(0)) + alpha * 16 ** digits
    classes = written(spark, _priors(rows).join(totals, "label", "left").select(
        "label", "rows", "prior", F.coalesce("total", F.lit(0)).alias("total"), F.log(F.lit(alpha) / room).alias("unseen")), "classes")
    weight = F.log((F.col("n") + alpha) / (F.col("total") + alpha * 16 ** digits))
    features = counts.join(F.broadcast(classes.select("label", "total")), "label").select("label", "feature", "n", weight.alias("weight"))
    return BayesModel("text", classes, written(spark, features, "features"))


def train_vectors(
    spark: SparkSession, df: DataFrame, vector: str = "embedding", label: str = "label", least: float = LEAST_VARIANCE,
) -> BayesModel:
    """Normal naive Bayes over the components of stored vectors; a variance is ``least`` at least."""
    rows = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.col(vector).alias("_v"))
    parts = _components(rows, ["label"])
    features = parts.groupBy("label", "feature").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.greatest(F.var_pop("x"), F.lit(least)).alias("variance"))
    return BayesModel("vector", written(spark, _priors(rows), "classes"), written(spark, features, "features"))


def _components(rows: DataFrame, keep: Sequence[str]) -> DataFrame:
    parts = rows.select(*keep, F.posexplode(F.coalesce("_v", F.array())).alias("feature", "_x"))
    return parts.select(*keep, "feature", F.col("_x").cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")


def _class_names(model: BayesModel, most: int = MOST_CLASSES) -> list:
    """The sorted classes of a model; more than ``most`` are an error, since a row carries one sum for each."""
    found = [r[0] for r in model.classes.select("label").orderBy("label").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} classes")
    return found


def _wide(model: BayesModel, names: Sequence, *values: str) -> DataFrame:
    """One row per feature: an array over the classes, null where a class does not know the feature."""
    known = F.map_from_entries(F.collect_list(F.struct("label", F.struct(*values))))  # one entry per class
    return model.features.groupBy("feature").agg(known.alias("_m")).select(
        "feature", F.array(*[F.col("_m")[F.lit(c)] for c in names]).alias("_k"))


def scores(model: BayesModel, df: DataFrame, row: str, feature_column: str, digits: int = DIGITS) -> tuple[DataFrame, list]:
    """``row`` and ``scores`` (the log of prior times likelihood, class by class) for every row, and the classes in order. ``row`` names the
    rows: it must be unique."""
    names = _class_names(model)
    if not names:
        return df.select(row, F.array().cast("array<double>").alias("scores")), names
    priors = {r["label"]: r for r in model.classes.collect()}
    if model.kind == "text":
        words = df.select(row, F.explode_outer(tokens(F.col(feature_column))).alias("_w")).select(row, hashed_word(F.col("_w"), digits).alias("feature"))
        wide, base = _wide(model, names, "weight"), F.col("feature").isNotNull().cast("double")
        parts = words.join(F.broadcast(wide), "feature", "left")
        gain = lambda k, c: F.coalesce(F.col("_k")[k]["weight"], F.lit(priors[c]["unseen"]) * base)
    else:
        places = F.when(F.size(feature_column) > 0, F.col(feature_column))  # an empty or null vector is one row without a place
        cells = df.select(row, F.posexplode_outer(places).alias("feature", "_x")).select(row, "feature", F.col("_x").cast("double").alias("x"))
        parts = cells.join(F.broadcast(_wide(model, names, "mean", "variance")), "feature", "left")

        def gain(k, c):
            m, v = F.col("_k")[k]["mean"], F.col("_k")[k]["variance"]
            log = -(F.col("x") - m) * (F.col("x") - m) / (v * 2) - F.log(v * 6.283185307179586) / 2
            return F.when(F.isnan("x"), F.lit(0.0)).otherwise(F.coalesce(log, F.lit(0.0)))

    sums = parts.groupBy(row).agg(*[F.sum(gain(k, c)).alias(f"_s{k}") for k, c in enumerate(names)])
    return sums.select(row, F.array(*[F.col(f"_s{k}") + F.lit(priors[c]["prior"]) for k, c in enumerate(names)]).alias("scores")), names


def predict(
    model: BayesModel, df: DataFrame, row: str, feature_column: str, model_name: str, keep: Sequence[str] = (), digits: int = DIGITS,
) -> DataFrame:
    """``row``, ``keep``, ``predicted_label`` and the name of the model. ``keep`` is fetched again by the row key, so texts do not travel."""
    found, names = scores(model, df, row, feature_column, digits)
    label = F.array(*map(F.lit, names))[best_class(F.col("scores"))] if names else F.lit(None).cast("string")
    found = found.select(row, label.alias("predicted_label"), F.lit(model_name).alias("model_name_or_path"))
    return df.select(row, *keep).join(found, row) if keep else found
