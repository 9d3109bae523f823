"""Argmax, confusion matrix, per-class report, macro scores, loss, best model.

Everything reduces to one small aggregate -- counts per (true, predicted)
class -- and then works on that grid of at most classes^2 rows.  The class
list is declared (``classes``), so a class that is never predicted, or absent
from the truth, still has its row and column (zero counts; precision, recall
and F1 of 0 where the denominator is 0).  A class that is not declared, or null,
keeps the cells it occurs in and counts in every score: no row vanishes.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.session import cut_lineage

CLASSES = (0, 1, 2)


def argmax(scores: Column) -> Column:
    """Index of the largest score; ties go to the lowest index."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def with_prediction(df: DataFrame, scores: str = "scores", out: str = "y_pred") -> DataFrame:
    return df.withColumn(out, argmax(F.col(scores)))


def _grid(spark, classes: Sequence[int]) -> DataFrame:
    n = len(classes)
    arr = F.array(*[F.lit(c) for c in classes])
    return spark.range(n * n).select(F.element_at(arr, (F.col("id") / n).cast("int") + 1).alias("y_true"),
                                     F.element_at(arr, (F.col("id") % n).cast("int") + 1).alias("y_pred"))


def confusion_matrix(df: DataFrame, classes: Sequence[int] = CLASSES, truth: str = "y_true",
                     pred: str = "y_pred") -> DataFrame:
    """E5 + E6: (y_true, y_pred, n, share) over the full class grid.

    ``share`` is n over its predicted-class column total (precision view),
    rounded to 2 decimals as numpy's ``around`` does (half to even on the
    scaled double); null for an empty column.
    """
    counts = df.groupBy(F.col(truth).alias("y_true"), F.col(pred).alias("y_pred")).agg(
        F.count(F.lit(1)).alias("n"))
    grid = _grid(df.sparkSession, classes)
    seen = counts.toDF("_t", "_p", "_n")
    cells = grid.join(seen, F.col("y_true").eqNullSafe(F.col("_t")) & F.col("y_pred").eqNullSafe(F.col("_p")), "full").select(
        F.when(F.col("_n").isNull(), F.col("y_true")).otherwise(F.col("_t")).alias("y_true"),
        F.when(F.col("_n").isNull(), F.col("y_pred")).otherwise(F.col("_p")).alias("y_pred"),
        F.coalesce("_n", F.lit(0)).alias("n"))
    col_total = F.sum("n").over(Window.partitionBy("y_pred"))
    share = F.try_divide(F.col("n").cast("double"), col_total)
    return cells.withColumn("share", F.rint(share * 100.0) / 100.0)


def per_class(cm: DataFrame) -> DataFrame:
    """(class, tp, predicted, support) from the confusion grid."""
    truth, pred = F.col("y_true"), F.col("y_pred")
    sides = cm.select("n", F.explode(F.array(F.struct(truth.alias("cls"), F.lit(True).alias("true")),
                                             F.struct(pred.alias("cls"), F.lit(False).alias("true")))).alias("s"),
                      truth.eqNullSafe(pred).alias("same"))
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    return sides.groupBy(F.col("s.cls").alias("cls")).agg(
        part(F.col("s.true")).alias("support"), part(F.col("s.true") & F.col("same")).alias("tp"),
        part(~F.col("s.true")).alias("predicted"))


def _safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def classification_report(df: DataFrame, classes: Sequence[int] = CLASSES, truth: str = "y_true",
                          pred: str = "y_pred") -> DataFrame:
    """Precision, recall, F1, support per class plus macro avg, weighted avg, accuracy."""
    # One pass over the scored rows; every report row then reads the classes^2 grid.
    pc = per_class(cut_lineage(confusion_matrix(df, classes, truth, pred)))
    p = _safe_ratio(F.col("tp"), F.col("predicted"))
    r = _safe_ratio(F.col("tp"), F.col("support"))
    pc = pc.withColumn("precision", p).withColumn("recall", r)
    pc = pc.withColumn("f1_score", _safe_ratio(2 * F.col("precision") * F.col("recall"),
                                               F.col("precision") + F.col("recall")))
    rows = pc.select(F.col("cls").cast("string").alias("class"), "precision", "recall", "f1_score",
                     F.col("support").cast("long").alias("support"))
    total = F.sum("support")
    summary = pc.agg(
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1_score").alias("mf"),
        _safe_ratio(F.sum(F.col("precision") * F.col("support")), total).alias("wp"),
        _safe_ratio(F.sum(F.col("recall") * F.col("support")), total).alias("wr"),
        _safe_ratio(F.sum(F.col("f1_score") * F.col("support")), total).alias("wf"),
        _safe_ratio(F.sum("tp"), total).alias("acc"),
        total.cast("long").alias("n"))
    macro = summary.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                           F.col("mr").alias("recall"), F.col("mf").alias("f1_score"), F.col("n").alias("support"))
    weighted = summary.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                              F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                              F.col("n").alias("support"))
    accuracy = summary.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                              F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                              F.col("n").alias("support"))
    return rows.unionByName(macro).unionByName(weighted).unionByName(accuracy)


def macro_scores(df: DataFrame, classes: Sequence[int] = CLASSES, truth: str = "y_true",
                 pred: str = "y_pred") -> DataFrame:
    """E2 + E3: one row of macro precision, recall, F1 and accuracy."""
    rep = classification_report(df, classes, truth, pred)
    return rep.agg(
        F.max(F.when(F.col("class") == "macro avg", F.col("precision"))).alias("precision_macro"),
        F.max(F.when(F.col("class") == "macro avg", F.col("recall"))).alias("recall_macro"),
        F.max(F.when(F.col("class") == "macro avg", F.col("f1_score"))).alias("f1_macro"),
        F.max(F.when(F.col("class") == "accuracy", F.col("f1_score"))).alias("accuracy"))


def cross_entropy(df: DataFrame, scores: str = "scores", truth: str = "y_true") -> DataFrame:
    """Mean softmax cross-entropy from logits, log-sum-exp stabilised."""
    s = F.col(scores)
    m = F.array_max(s)
    lse = m + F.log(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    loss = lse - F.element_at(s, F.col(truth) + 1)
    return df.agg(F.avg(loss).alias("loss"), F.count(F.lit(1)).alias("n"))


def best_model(metrics: DataFrame, model: str = "model_id", metric: str = "val_f1") -> DataFrame:
    """The model with the highest validation metric (ties: smallest id)."""
    return metrics.agg(F.min_by(model, F.struct(-F.col(metric), F.col(model))).alias(model),
                       F.max(metric).alias(metric))
