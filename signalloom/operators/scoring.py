"""Batched scoring with a pluggable model, and a weighted baseline classifier."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from signalloom.functions.scalars import sigmoid
from signalloom.operators.metrics import ranking_metrics
from signalloom.operators.splits import class_weights
from signalloom.session import settle

REG_PARAMS = (0.0, 0.001, 0.01, 0.1)


def score_batches(
    windows: DataFrame,
    load_model: Callable[[], Callable[[np.ndarray], np.ndarray]],
    column: str,
    shape: Sequence[int],
    batch_size: int = 256,
) -> DataFrame:
    """Add ``logit`` and ``y_prob``.

    ``load_model`` runs once per worker process and returns a function from an
    ``(n, *shape)`` array to ``n`` logits.
    """
    predict = predict_batch_udf(
        load_model, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    flat = F.flatten(column) if len(shape) > 1 else F.col(column)
    return windows.withColumn("logit", predict(flat)).withColumn("y_prob", sigmoid("logit"))


def train_weighted_baseline(
    train: DataFrame,
    validation: DataFrame,
    features: str = "features",
    label: str = "label",
    reg_params: Sequence[float] = REG_PARAMS,
) -> tuple[LogisticRegressionModel, list[tuple[float, float]]]:
    """Class-balanced logistic regressions; the best validation PR-AUC wins.

    The first of equally good settings is kept. Returns the model and the
    ``(regParam, PR-AUC)`` of every setting.
    """
    weighted = class_weights(train.select(features, label), label).withColumn(
        "_x", array_to_vector(F.col(features).cast("array<double>"))
    )
    # Rescaled so that the weights average 1; their ratio is what balances.
    total = weighted.agg(F.count(F.lit(1))).scalar()
    weighted = weighted.withColumn("_n", total).withColumn("weight", F.col("weight") * F.col("_n") / 2).drop("_n")
    weighted = settle(weighted.select("_x", label, "weight"), "training")
    validation = settle(validation.select(features, label), "validation")
    best, best_ap, tried = None, -1.0, []
    for reg in reg_params:
        learner = LogisticRegression(
            featuresCol="_x", labelCol=label, weightCol="weight", regParam=float(reg), maxIter=50
        )
        model = learner.fit(weighted)
        scores = score_with(model, validation, features).withColumnRenamed(label, "y_true")
        ap = ranking_metrics(scores).first()["pr_auc"]
        ap = -1.0 if ap is None else float(ap)
        tried.append((float(reg), ap))
        if best is None or ap > best_ap:
            best, best_ap = model, ap
    return best, tried


def score_with(model: LogisticRegressionModel, windows: DataFrame, features: str = "features") -> DataFrame:
    """Add ``logit`` and ``y_prob`` of a fitted model (evaluated in the JVM)."""
    scored = model.transform(windows.withColumn("_x", array_to_vector(F.col(features).cast("array<double>"))))
    return (
        scored.withColumn("logit", vector_to_array("rawPrediction")[1])
        .withColumn("y_prob", vector_to_array("probability")[1])
        .drop("_x", "rawPrediction", "probability", "prediction")
    )
