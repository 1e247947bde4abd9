"""Tuned tree baseline: a random search with cross-validation over Spark's boosted trees.

Every fit runs over all labelled rows on the executors; only model sizes and scores come back. Draws and
folds are searched side by side.
"""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.ml.evaluation import BinaryClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The search space of the tuned baseline.
SEARCH_SPACE = {
    "trees": (100, 200, 400, 600),
    "depth": (3, 4, 6, 8, 10),
    "rate": (0.01, 0.03, 0.1, 0.3),
    "row_share": (0.6, 0.8, 1.0),
    "feature_share": (0.6, 0.8, 1.0),
}
DRAWS, FOLDS = 15, 3
#: Fits that run side by side.
PARALLEL = 4


def draw_grid(space: Mapping[str, Sequence], draws: int, seed: int) -> list[dict]:
    """Distinct random points of the space; the whole space if it is smaller."""
    chooser, points, size = random.Random(seed), [], int(np.prod([len(c) for c in space.values()]))
    while len(points) < min(draws, size):
        point = {name: chooser.choice(choices) for name, choices in space.items()}
        if point not in points:
            points.append(point)
    return points


def tuned_trees(
    train: DataFrame,
    test: DataFrame,
    features: Sequence[str],
    label: str,
    regression: bool = False,
    draws: int = DRAWS,
    folds: int = FOLDS,
    space: Mapping[str, Sequence] = SEARCH_SPACE,
    seed: int = 0,
    parallel: int = PARALLEL,
) -> DataFrame:
    """Predictions of the best boosted trees on every row of `test`.

    Returns the test rows with `yhat`, and `score` (probability of class 1) for a classifier. Null
    features count as -1; rows without a label teach nothing. A row's fold follows from a hash of the row, so
    equal rows never stand on both sides of a fold.
    """
    def assembled(df: DataFrame) -> DataFrame:
        numbers = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(f"_x{i}") for i, c in enumerate(features)]
        vectors = VectorAssembler(inputCols=[f"_x{i}" for i in range(len(features))], outputCol="_features")
        return vectors.transform(df.select("*", *numbers)).drop(*[f"_x{i}" for i in range(len(features))])

    columns = {"labelCol": "_y", "featuresCol": "_features", "seed": seed}
    trees = GBTRegressor(**columns) if regression else GBTClassifier(**columns)
    points = [
        {
            trees.maxIter: p["trees"], trees.maxDepth: p["depth"], trees.stepSize: p["rate"],
            trees.subsamplingRate: p["row_share"], trees.featureSubsetStrategy: str(p["feature_share"]),
        }
        for p in draw_grid(space, draws, seed)
    ]
    judge = (
        RegressionEvaluator(labelCol="_y", metricName="rmse") if regression
        else BinaryClassificationEvaluator(labelCol="_y", metricName="areaUnderROC")
    )
    fold = F.pmod(F.xxhash64(F.lit(seed), *train.columns), F.lit(folds)).cast("int")
    known = assembled(train.filter(F.col(label).isNotNull())).select("_features", F.col(label).cast("double").alias("_y"), fold.alias("_fold"))
    search = CrossValidator(
        estimator=trees, estimatorParamMaps=points, evaluator=judge, numFolds=folds, foldCol="_fold", parallelism=parallel
    )
    predicted = search.fit(known).bestModel.transform(assembled(test))
    if regression:
        return predicted.select(*test.columns, F.col("prediction").alias("yhat"))
    score = vector_to_array("probability")[1]
    return predicted.select(*test.columns, score.alias("score"), (score >= 0.5).cast("double").alias("yhat"))
