"""Classifiers in closed form, all variants scored and compared in one scan.

Everything the fits need is one aggregation: per class and dimension the number of rows, the sum and the sum of squares.
From these come three classifiers, whose scores are log joint densities of independent Gaussians:

* ``0`` naive Bayes: the class's own means and variances;
* ``1`` pooled: the class's means, one variance a dimension for all classes;
* ``2`` nearest mean: unit variances and equal priors.

A score is a quadratic function of the vector, so all variants of all classes together are one matrix, applied to every
batch of rows at once.  The matrix has (2 * dimensions) x (variants * classes) numbers, as many as the aggregation has rows;
nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow.operators.knn import class_sizes
from txnflow.session import ship_package

VARIANTS = ("naive_bayes", "pooled", "nearest_mean")
SMOOTHING = 1e-9               # of the largest variance of a dimension, added to all variances


def class_statistics(train: DataFrame, features: str = "features", label: str = "label") -> DataFrame:
    """(label, dim, n, total, squares): one row a class and dimension, combined by every task before the shuffle."""
    cells = train.where(F.col(features).isNotNull() & F.col(label).isNotNull()).select(label, F.posexplode(features).alias("dim", "x"))
    return cells.groupBy(label, "dim").agg(F.count("x").alias("n"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


class GaussianModels:
    """The variants for declared classes; a class without training rows is never predicted (its scores are -1e300)."""

    def __init__(self, rows, classes: Sequence[int], dims: int):
        k = {c: i for i, c in enumerate(classes)}
        n, s1, s2 = np.zeros((len(classes), dims)), np.zeros((len(classes), dims)), np.zeros((len(classes), dims))
        for label, dim, count, total, squares in rows:
            if label in k:
                n[k[label], dim], s1[k[label], dim], s2[k[label], dim] = count, total, squares
        seen = n[:, 0] > 0 if dims else np.zeros(len(classes), bool)
        safe = np.maximum(n, 1.0)
        mean = s1 / safe
        all_n = np.maximum(n.sum(axis=0), 1.0)
        spread = s2.sum(axis=0) / all_n - (s1.sum(axis=0) / all_n) ** 2
        smooth = SMOOTHING * max(float(spread.max(initial=0.0)), 1e-12)
        own = np.maximum(s2 / safe - mean ** 2, 0.0) + smooth
        pooled = np.maximum((s2 - s1 ** 2 / safe).sum(axis=0) / all_n, 0.0) + smooth
        prior = np.log(np.maximum(n[:, 0], 1.0) / all_n[0]) if dims else np.zeros(len(classes))
        self.quadratic, self.linear, self.constant = [], [], []
        for variance, start in ((own, prior), (np.broadcast_to(pooled, own.shape), prior), (np.ones_like(own), np.zeros_like(prior))):
            self.quadratic.append(-0.5 / variance)
            self.linear.append(mean / variance)
            constant = start - 0.5 * (np.log(2 * np.pi * variance) + mean ** 2 / variance).sum(axis=1)
            self.constant.append(np.where(seen, constant, -1e300))
        self.classes = list(classes)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """rows x variants x classes."""
        weights = np.concatenate([np.concatenate([q, m], axis=1) for q, m in zip(self.quadratic, self.linear)])
        flat = np.concatenate([x * x, x], axis=1) @ weights.T + np.concatenate(self.constant)
        return flat.reshape(len(x), len(VARIANTS), len(self.classes))


def fit_gaussians(train: DataFrame, classes: Sequence[int], features: str = "features", label: str = "label") -> GaussianModels:
    """One pass over the training rows; classes are checked to be few."""
    class_sizes(train, label)
    rows = [tuple(r) for r in class_statistics(train, features, label).collect()]
    return GaussianModels(rows, classes, max((r[1] + 1 for r in rows), default=0))


def score_variants(df: DataFrame, models: GaussianModels, features: str = "features") -> DataFrame:
    """``df`` without its features, one row a variant: model_id, scores (one a class), y_pred (ties: the first class).

    Rows without features take no part.
    """
    ship_package(df.sparkSession)
    own = [c for c in df.columns if c != features]
    classes = np.array(models.classes, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(len(own)).flatten().to_numpy().reshape(batch.num_rows, -1)
            scores = models.scores(x)
            rows = np.repeat(np.arange(len(x)), len(VARIANTS))
            offsets = np.arange(len(rows) + 1, dtype=np.int32) * len(classes)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i).take(pa.array(rows)) for i in range(len(own))],
                 pa.array(np.tile(np.arange(len(VARIANTS), dtype=np.int32), len(x))),
                 pa.ListArray.from_arrays(pa.array(offsets), pa.array(scores.ravel())),
                 pa.array(classes[scores.argmax(axis=2).ravel()])], [*own, "model_id", "scores", "y_pred"])

    rows = df.where(F.col(features).isNotNull()).select(*own, F.col(features).cast("array<double>"))
    schema = T.StructType([*[df.schema[c] for c in own], T.StructField("model_id", T.IntegerType()),
                           T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("y_pred", T.IntegerType())])
    return rows.mapInArrow(run, schema)


def metrics_by_model(scored: DataFrame, classes: Sequence[int], truth: str = "y_true", pred: str = "y_pred",
                     model: str = "model_id") -> DataFrame:
    """(model, f1_macro, accuracy, n) of every model from one grouping of the scored rows.

    Declared classes count in the mean also where they never occur (F1 0).
    """
    cells = scored.groupBy(model, truth, pred).agg(F.count(F.lit(1)).alias("n"))          # models x classes^2 rows
    cells = cells.withColumn("hit", F.when(F.col(truth) == F.col(pred), F.col("n")).otherwise(0))
    sides = cells.select(model, "n", "hit", F.explode(F.array(F.struct(F.col(truth).alias("class"), F.lit(1).alias("true")),
                                                              F.struct(F.col(pred).alias("class"), F.lit(0).alias("true")))).alias("side"))
    by_class = sides.groupBy(model, F.col("side.class").alias("class")).agg(
        F.sum("n").alias("both"), F.sum(F.when(F.col("side.true") == 1, F.col("hit")).otherwise(0)).alias("hit"))
    # F1 = 2 tp / (predicted + support)
    f1 = by_class.groupBy(model).agg(F.sum(2.0 * F.col("hit") / F.col("both")).alias("f1"))
    known = F.lit(float(len(classes)))
    whole = cells.groupBy(model).agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    return f1.join(whole, model).select(model, (F.col("f1") / known).alias("f1_macro"), (F.col("hit") / F.col("n")).alias("accuracy"), "n")
