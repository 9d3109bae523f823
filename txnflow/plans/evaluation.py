"""Entry 4 queries: closed-form classifiers over all classes and components, their metrics, and the best of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.operators.bayes import SMOOTHING, VARIANTS, fit_gaussians, metrics_by_model, score_variants
from txnflow.operators.evaluation import (best_model, classification_report, confusion_matrix, cross_entropy,
                                          macro_scores)
from txnflow.operators.sampling import stratified_split
from txnflow.plans.registry import register
from txnflow.plans.sampling import split_sql
from txnflow.plans.sql import CTE, with_ctes
from txnflow.session import cut_lineage
from txnflow.sources import testdata as td

CLASSES = tuple(range(10))      # the labels of the embedding vectors

CTE["emb_label"] = "SELECT vec_id AS id, CAST(label AS INTEGER) AS label FROM embeddings"
CTE["emb_split"] = split_sql("emb_label", "id")
CTE["emb_cells"] = """
SELECT s.split, s.id, s.label, unnest(range(len(e.embedding))) AS dim, CAST(unnest(e.embedding) AS DOUBLE) AS x
FROM emb_split s JOIN embeddings e ON s.id = e.vec_id
"""
CTE["class_stats"] = """
SELECT label, dim, count(*) AS n, sum(x) AS s1, sum(x * x) AS s2 FROM emb_cells WHERE split = 'train' GROUP BY label, dim
"""
CTE["dim_stats"] = """
SELECT dim, sum(n) AS n, sum(s2) / sum(n) - (sum(s1) / sum(n)) ** 2 AS spread, sum(s2 - s1 * s1 / n) / sum(n) AS pooled
FROM class_stats GROUP BY dim
"""
CTE["gaussians"] = f"""
SELECT m.model_id, c.label AS cls, c.dim, c.s1 / c.n AS mean, ln(c.n / d.n) AS prior,
  CASE m.model_id WHEN 0 THEN greatest(c.s2 / c.n - (c.s1 / c.n) ** 2, 0) + (SELECT max(spread) FROM dim_stats) * {SMOOTHING}
                  WHEN 1 THEN greatest(d.pooled, 0) + (SELECT max(spread) FROM dim_stats) * {SMOOTHING} ELSE 1 END AS variance
FROM class_stats c JOIN dim_stats d ON c.dim = d.dim, (SELECT unnest(range({len(VARIANTS)})) AS model_id) m
"""
CTE["class_scores"] = """
SELECT x.split, x.id, x.label AS y_true, g.model_id, g.cls,
  any_value(CASE WHEN g.model_id < 2 THEN g.prior ELSE 0 END) - 0.5 * sum(ln(2 * pi() * g.variance) + (x.x - g.mean) ** 2 / g.variance) AS score
FROM emb_cells x JOIN gaussians g ON x.dim = g.dim WHERE x.split IN ('val', 'test') GROUP BY ALL
"""
CTE["all_scored"] = """
SELECT split, id, y_true, CAST(model_id AS INTEGER) AS model_id, list(score ORDER BY cls) AS scores,
  CAST(list_position(list(score ORDER BY cls), max(score)) - 1 AS INTEGER) AS y_pred
FROM class_scores GROUP BY split, id, y_true, model_id
"""
CTE["model_metrics"] = """
WITH c AS (SELECT DISTINCT model_id, unnest(range(10)) AS cls FROM all_scored),
t AS (SELECT c.model_id, c.cls, count(*) FILTER (WHERE y_true = cls AND y_pred = cls) AS hit,
        count(*) FILTER (WHERE y_true = cls) + count(*) FILTER (WHERE y_pred = cls) AS occurs
      FROM c JOIN all_scored s ON c.model_id = s.model_id AND s.split = 'val' GROUP BY c.model_id, c.cls),
w AS (SELECT model_id, count(*) FILTER (WHERE y_true = y_pred) / count(*) AS accuracy, count(*) AS n
      FROM all_scored WHERE split = 'val' GROUP BY model_id)
SELECT t.model_id, sum(coalesce(2.0 * hit / nullif(occurs, 0), 0)) / 10.0 AS f1_macro, any_value(accuracy) AS accuracy, any_value(w.n) AS n
FROM t JOIN w ON t.model_id = w.model_id GROUP BY t.model_id
"""
CTE["best"] = "SELECT model_id, f1_macro AS val_f1 FROM model_metrics ORDER BY round(f1_macro, 12) DESC, model_id LIMIT 1"
CTE["pred"] = """
SELECT id, y_true, scores, y_pred FROM all_scored WHERE split = 'test' AND model_id = (SELECT model_id FROM best)
"""
CTE["cm"] = """
WITH grid AS (SELECT CAST(a.c AS INTEGER) AS y_true, CAST(b.c AS INTEGER) AS y_pred
              FROM (SELECT unnest(range(10)) AS c) a, (SELECT unnest(range(10)) AS c) b),
cnt AS (SELECT y_true, y_pred, count(*) AS n FROM pred GROUP BY y_true, y_pred)
SELECT g.y_true, g.y_pred, coalesce(c.n, 0) AS n FROM grid g LEFT JOIN cnt c ON g.y_true = c.y_true AND g.y_pred = c.y_pred
"""
CTE["report"] = """
WITH pc AS (
  SELECT c.cls, (SELECT sum(n) FROM cm WHERE y_true = c.cls) AS support,
    (SELECT sum(n) FROM cm WHERE y_pred = c.cls) AS predicted,
    (SELECT sum(n) FROM cm WHERE y_true = c.cls AND y_pred = c.cls) AS tp
  FROM (SELECT unnest(range(10)) AS cls) c),
p2 AS (SELECT *, coalesce(tp / nullif(predicted, 0), 0.0) AS precision,
                 coalesce(tp / nullif(support, 0), 0.0) AS recall FROM pc),
p3 AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1_score FROM p2)
SELECT CAST(cls AS VARCHAR) AS class, precision, recall, f1_score, CAST(support AS BIGINT) AS support FROM p3
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), CAST(sum(support) AS BIGINT) FROM p3
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  sum(f1_score * support) / sum(support), CAST(sum(support) AS BIGINT) FROM p3
UNION ALL SELECT 'accuracy', NULL, NULL, sum(tp) / sum(support), CAST(sum(support) AS BIGINT) FROM p3
"""
FITTED = ["emb_label", "emb_split", "emb_cells", "class_stats", "dim_stats", "gaussians", "class_scores", "all_scored"]
BEST = FITTED + ["model_metrics", "best"]
EVAL = BEST + ["pred", "cm", "report"]


def scored_variants(spark, sf_dir):
    """Validation and test rows of the embedding vectors, scored by every variant fitted to the training rows."""
    v = td.vectors(spark, sf_dir)
    split = stratified_split(v.select("id", "label"), key="id")
    data = cut_lineage(v.join(split.select("id", "split"), "id"))           # read by the fit and the scoring
    models = fit_gaussians(data.where("split = 'train'"), CLASSES)
    rows = data.where("split IN ('val', 'test')").withColumnRenamed("label", "y_true")
    return cut_lineage(score_variants(rows, models))                           # read by the choice and by what follows


def _metrics(scored):
    return metrics_by_model(scored.where("split = 'val'"), CLASSES).withColumn("f1_macro", F.round("f1_macro", 12))


def predictions(spark, sf_dir):
    """Test rows as the variant with the best validation F1 scores them."""
    scored = scored_variants(spark, sf_dir)
    best = best_model(_metrics(scored), metric="f1_macro").first()["model_id"]
    return scored.where((F.col("split") == "test") & (F.col("model_id") == best))


@register("gaussian_scores", sql=with_ctes(FITTED, """
SELECT model_id, id, y_true, y_pred, list_transform(scores, lambda s: round(s, 6)) AS scores FROM all_scored WHERE split = 'test'"""))
def q_gaussian_scores(spark, sf_dir):
    """Every test row under every variant, a score for each of the ten classes."""
    scored = scored_variants(spark, sf_dir).where("split = 'test'")
    return scored.select("model_id", "id", "y_true", "y_pred", F.transform("scores", lambda s: F.round(s, 6)).alias("scores"))


@register("model_metrics", sql=with_ctes(BEST[:-1], """
SELECT model_id, round(f1_macro, 9) AS f1_macro, round(accuracy, 9) AS accuracy, n FROM model_metrics"""))
def q_model_metrics(spark, sf_dir):
    """Validation metrics of all variants, from one scan of their scores."""
    return _round9(_metrics(scored_variants(spark, sf_dir)))


@register("best_model", sql=with_ctes(BEST, "SELECT model_id, round(val_f1, 9) AS val_f1 FROM best"))
def q_best_model(spark, sf_dir):
    """The variant with the highest validation F1."""
    best = best_model(_metrics(scored_variants(spark, sf_dir)), metric="f1_macro")
    return best.select("model_id", F.round("f1_macro", 9).alias("val_f1"))


@register("confusion_matrix", sql=with_ctes(EVAL[:-1], """
SELECT y_true, y_pred, n, round_even(n / nullif(sum(n) OVER (PARTITION BY y_pred), 0) * 100.0, 0) / 100.0 AS share
FROM cm"""))
def q_confusion_matrix(spark, sf_dir):
    return confusion_matrix(predictions(spark, sf_dir), CLASSES)


def _round9(df):
    return df.select(*[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@register("classification_report", sql=with_ctes(EVAL, """
SELECT class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1_score, 9) AS f1_score, support
FROM report"""))
def q_classification_report(spark, sf_dir):
    return _round9(classification_report(predictions(spark, sf_dir), CLASSES))


@register("macro_scores", sql=with_ctes(EVAL, """
SELECT round(max(CASE WHEN class = 'macro avg' THEN precision END), 9) AS precision_macro,
       round(max(CASE WHEN class = 'macro avg' THEN recall END), 9) AS recall_macro,
       round(max(CASE WHEN class = 'macro avg' THEN f1_score END), 9) AS f1_macro,
       round(max(CASE WHEN class = 'accuracy' THEN f1_score END), 9) AS accuracy FROM report"""))
def q_macro_scores(spark, sf_dir):
    return _round9(macro_scores(predictions(spark, sf_dir), CLASSES))


@register("cross_entropy", sql=with_ctes(EVAL[:-2], """
SELECT round(avg(list_max(scores) + ln(list_sum(list_transform(scores, lambda x: exp(x - list_max(scores)))))
                 - scores[y_true + 1]), 9) AS loss, count(*) AS n FROM pred"""))
def q_cross_entropy(spark, sf_dir):
    return _round9(cross_entropy(predictions(spark, sf_dir)))
