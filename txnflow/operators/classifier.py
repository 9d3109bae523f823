"""Train a multi-class classifier on sequence vectors, pick the best, score.

The original trains an LSTM on one machine; here a ``pyspark.ml``
multinomial logistic regression (distributed L-BFGS) is fitted on the
flattened T x F vectors for a few regularisation strengths, the best by
validation macro F1 is kept (E8), and test rows are scored in parallel.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.operators.evaluation import argmax, best_model, macro_scores


def _vectors(df: DataFrame, features: str) -> DataFrame:
    return df.withColumn("_x", array_to_vector(F.col(features)))


def _declare_classes(df: DataFrame, label: str, n_classes: int) -> DataFrame:
    """Nominal label metadata: the model has ``n_classes`` outputs even when a
    class is missing from the training rows (its probability is then ~0)."""
    meta = {"ml_attr": {"type": "nominal", "name": label, "num_vals": n_classes}}
    return df.withColumn(label, F.col(label).cast("double").alias(label, metadata=meta))


def train_best(train: DataFrame, val: DataFrame, features: str = "features", label: str = "label",
               reg_params: Sequence[float] = (0.0, 0.01, 0.1), max_iter: int = 50, n_classes: int = 3):
    """Fit one model per regularisation strength; return (best model, metrics table).

    E8: the model with the highest validation macro F1 wins (ties: lowest id).
    """
    tr, va = _declare_classes(_vectors(train, features), label, n_classes), _vectors(val, features)
    fitted, metrics = [], []
    for i, reg in enumerate(reg_params):
        model = LogisticRegression(featuresCol="_x", labelCol=label, regParam=reg, maxIter=max_iter,
                                   family="multinomial").fit(tr)
        scored = score(model, va, features=None, truth=label)
        m = macro_scores(scored.select(F.col(label).cast("int").alias("y_true"), "y_pred"), range(n_classes)).first()
        fitted.append(model)
        metrics.append((i, float(reg), float(m["f1_macro"])))
    table = train.sparkSession.createDataFrame(metrics, "model_id int, reg_param double, val_f1 double")
    best = best_model(table).first()["model_id"]
    return fitted[best], table


def score(model, df: DataFrame, features: str | None = "features", truth: str = "label") -> DataFrame:
    """Scores (one logit per class, as the cross-entropy expects) and argmax prediction for every row."""
    x = _vectors(df, features) if features is not None else df
    if "_x" not in x.columns:
        x = _vectors(df, "features")
    out = model.transform(x).withColumn("scores", vector_to_array("rawPrediction"))
    return out.withColumn("y_pred", argmax(F.col("scores"))).drop("_x", "rawPrediction", "probability",
                                                                   "prediction")
