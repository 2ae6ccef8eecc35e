"""Text classification: features, training, parameter search, prediction."""

from __future__ import annotations

import math
import random
from collections.abc import Mapping, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark.functions.answers import best_class
from tallymark.operators.metrics import macro_f1
from tallymark.operators.search import Trial, best_trial, run_search
from tallymark.session import written

MAX_ITER = 100
# What the search draws from: from hardly any to strong regularisation, and from a rough to a full fit.
SPACE = {
    "reg_param": ("log", 1e-4, 1e-1),
    "max_iter": ("int", 10, 60),
    "elastic_net": ("choice", (0.0, 0.5, 1.0)),
}


def text_stages(text: str = "text", num_features: int = 1 << 16) -> list:
    """Words, hashed word counts and their inverse document weights as ``features``."""
    return [
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{N}]+"),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=num_features),
        IDF(inputCol="_counts", outputCol="features"),
    ]


def vector_features(df: DataFrame, vector: str) -> DataFrame:
    """Use a stored embedding as ``features``."""
    return df.withColumn("features", array_to_vector(F.col(vector)))


def head(params: Mapping | None = None) -> LogisticRegression:
    params = params or {}
    return LogisticRegression(
        featuresCol="features", labelCol="label_id", probabilityCol="probability", predictionCol="_prediction",
        rawPredictionCol="_raw", maxIter=params.get("max_iter", MAX_ITER), regParam=params.get("reg_param", 0.0),
        elasticNetParam=params.get("elastic_net", 0.0),
    )


def train(df: DataFrame, params: Mapping | None = None, text: str | None = "text") -> PipelineModel:
    """Fit features and head on one frame; ``text=None`` expects a ``features`` column.

    Texts are split and hashed once: the word counts are stored, and the document weights and the head's passes read those.
    """
    if not text:
        return Pipeline(stages=[head(params)]).fit(df)
    words, counts, weights = text_stages(text)
    stored = written(df.sparkSession, counts.transform(words.transform(df)).select("label_id", "_counts"), "word-counts")
    fitted = weights.fit(stored)
    return PipelineModel(stages=[words, counts, fitted, head(params).fit(fitted.transform(stored))])


def class_table(df: DataFrame) -> DataFrame:
    """``label_id`` and ``label`` of every class."""
    return df.select("label_id", "label").distinct()


def predict(model: PipelineModel, df: DataFrame, classes: DataFrame, model_name: str) -> DataFrame:
    """Add ``label`` and ``predicted_label`` by name and the name of the model that was used.

    ``classes`` has a row per class. The model keeps weights per class in memory, so that table is small beside it.
    """
    keep = [c for c in df.columns if c not in ("label", "features")]
    scored = model.transform(df).select(*keep, best_class(vector_to_array("probability")).alias("_predicted"))
    names = F.broadcast(classes.select("label_id", "label"))
    guessed = F.broadcast(classes.select(F.col("label_id").alias("_predicted"), F.col("label").alias("predicted_label")))
    return scored.join(names, "label_id", "left").join(guessed, "_predicted", "left").select(
        *keep, "label", "predicted_label", F.lit(model_name).alias("model_name_or_path"))


def draw_params(n_trials: int, seed: int, space: Mapping = SPACE) -> list[dict]:
    """Seeded random parameter sets: log-uniform, integer or choice per name."""
    rng = random.Random(seed)

    def draw(rule: tuple):
        if rule[0] == "log":
            return math.exp(rng.uniform(math.log(rule[1]), math.log(rule[2])))
        if rule[0] == "int":
            return rng.randint(rule[1], rule[2])
        return rng.choice(rule[1])

    return [{name: draw(rule) for name, rule in space.items()} for _ in range(n_trials)]


def search(
    train_df: DataFrame, validation_df: DataFrame, n_trials: int, seed: int = 42, space: Mapping = SPACE,
    text: str = "text",
) -> tuple[PipelineModel, dict, list[dict]]:
    """Fit every drawn parameter set on train, score it on validation by macro F1, keep the best.

    The features are fitted once and cached for all trials; only the head is fitted again.
    """
    features = Pipeline(stages=text_stages(text)).fit(train_df)
    seen = features.transform(train_df).select("label_id", "features").persist()
    unseen = features.transform(validation_df).select("label_id", "features").persist()
    trials, best = [], None
    for number, params in enumerate(draw_params(n_trials, seed, space)):
        fitted = head(params).fit(seen)
        answers = fitted.transform(unseen).select(
            "label_id", best_class(vector_to_array("probability")).alias("predicted_id")
        )
        score = macro_f1(answers, "label_id", "predicted_id").first()["macro_f1"]
        trials.append({"trial": number, **params, "macro_f1": score})
        if best is None or score > best[0]:
            best = (score, fitted, params)
    seen.unpersist()
    unseen.unpersist()
    return PipelineModel(stages=[*features.stages, best[1]]), best[2], trials


def search_adaptively(
    train_df: DataFrame, validation_df: DataFrame, n_trials: int, seed: int = 42, space: Mapping = SPACE, text: str = "text",
    shares: Sequence[float] = (0.25, 1.0), key: str = "text_key",
) -> tuple[PipelineModel, dict, list[Trial]]:
    """Like ``search``, but each trial is drawn from what the earlier ones showed, and is stopped early if it is poor.

    A rung is a share of the training rows, the same rows for all trials, taken by the hash of ``key``; the last must be all of them. Only
    trials that pass the lower rungs are fitted on all rows. The best trial's model is kept from its fit.
    """
    if not shares or shares[-1] != 1.0:
        raise ValueError("the last share must be 1: the best model is one fitted on all rows")
    features = Pipeline(stages=text_stages(text)).fit(train_df)
    place = F.conv(F.substring(F.md5(F.col(key).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    seen = features.transform(train_df).select("label_id", "features", place.alias("_place")).persist()
    unseen = features.transform(validation_df).select("label_id", "features").persist()
    best: list = []

    def objective(params: dict, rung: int) -> float:
        fitted = head(params).fit(seen.where(F.col("_place") < shares[rung]))
        answers = fitted.transform(unseen).select(
            "label_id", best_class(vector_to_array("probability")).alias("predicted_id"))
        score = macro_f1(answers, "label_id", "predicted_id").first()["macro_f1"]
        if rung == len(shares) - 1 and (not best or score > best[0]):
            best[:] = [score, fitted]
        return score

    history = run_search(objective, space, n_trials, len(shares), seed)
    seen.unpersist()
    unseen.unpersist()
    return PipelineModel(stages=[*features.stages, best[1]]), best_trial(history).params, history


def model_path(path: str, category: str, model_name: str) -> str:
    return f"{path}/{category}/{model_name.replace('/', '_')}"


def save_model(model: PipelineModel, path: str, category: str, model_name: str) -> str:
    target = model_path(path, category, model_name)
    model.write().overwrite().save(target)
    return target


def load_model(path: str, category: str, model_name: str) -> PipelineModel:
    return PipelineModel.load(model_path(path, category, model_name))
