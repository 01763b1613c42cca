"""Pair classifiers with Spark ML: entity-grouped cross-validation, final fit, scoring."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scoring
from .splits import fold


def classifier(features: list[str], label: str = "label", kind: str = "trees", rounds: int = 20, depth: int = 5, step: float = 0.1, seed: int = 42, stop: str | None = None) -> Pipeline:
    """Boosted trees, or a logistic regression, over the named columns; rows weigh by column ``weight``.

    ``stop`` names a boolean column of rows that do not train the trees but end their rounds early, once these no longer lower the loss there.
    """
    gather = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep")
    if kind == "trees":
        model = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, maxDepth=depth, stepSize=step, seed=seed)
        if stop:
            model = model.setValidationIndicatorCol(stop)
    else:
        model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100)
    return Pipeline(stages=[gather, model])


def weighed(pairs: DataFrame, label: str = "label", positive: float = 5.0) -> DataFrame:
    return pairs.withColumn("weight", F.when(F.col(label) == 1, positive).otherwise(1.0))


def score(model, pairs: DataFrame, name: str = "p") -> DataFrame:
    return model.transform(pairs).withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def cross_validated(pairs: DataFrame, features: list[str], entity: str, label: str = "label", folds: int = 5, **how) -> DataFrame:
    """Pairs with out-of-fold scores ``p``; all pairs of an entity are in one fold. A fold is not used to stop its own training."""
    held = weighed(pairs, label).withColumn("fold", fold(F.col(entity), folds))
    parts = []
    for k in range(folds):
        model = classifier(features, label, **how).fit(held.filter(F.col("fold") != k))
        parts.append(score(model, held.filter(F.col("fold") == k)))
    return reduce(DataFrame.unionByName, parts).drop("weight")


def final(pairs: DataFrame, features: list[str], label: str = "label", **how):
    return classifier(features, label, **how).fit(weighed(pairs, label))


def importances(spark, model, features: list[str]) -> DataFrame:
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame(list(zip(features, values)), "feature string, importance double")


def decided(spark, held: DataFrame, population: DataFrame, truth: DataFrame, entity: str, target: str, source: str, thresholds: list[float], score: str = "p") -> dict:
    """The decision: the threshold of the best macro F0.5 of scored pairs that did not train the model, and where they come from."""
    best = scoring.best_threshold(scoring.sweep(population, truth, held, entity, target, score, thresholds)).first()
    return {"threshold": best["threshold"], "macro_f05": best["macro_f05"], "threshold_source": source, "scale": "raw_model_probability"}


def final_with_decision(train: DataFrame, features: list[str], population: DataFrame, truth: DataFrame, entity: str, target: str, thresholds: list[float], held_out: tuple[DataFrame, DataFrame, DataFrame] | None = None, folds: int = 5, **how):
    """(model, decision): a model of all training pairs, with a threshold from the held-out (pairs, population, truth), else from scores out of fold."""
    spark, model = train.sparkSession, final(train, features, **how)
    if held_out:
        pairs, whole, true = held_out
        return model, decided(spark, score_pairs(model, pairs), whole, true, entity, target, "held-out validation population", thresholds)
    return model, decided(spark, cross_validated(train, features, entity, folds=folds, **how), population, truth, entity, target, "out-of-fold training population", thresholds)


score_pairs = score


def write_decision(spark, decision: dict, path: str) -> None:
    """One line of JSON, through Spark's writer, so that any store will do."""
    spark.createDataFrame([(json.dumps(decision, sort_keys=True),)], "value string").coalesce(1).write.text(path)


def read_decision(spark, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])
