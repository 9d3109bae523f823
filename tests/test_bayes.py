"""Closed-form classifiers against a plain computation, and their metrics."""

import numpy as np
import pytest

from txnflow.operators import bayes
from txnflow.operators.evaluation import best_model

SCHEMA = "id long, label int, features array<double>"


def plain(train, x, classes):
    """Scores of the three variants from their definitions."""
    rows = {c: np.array([f for _, y, f in train if y == c]) for c in classes}
    every = np.concatenate([r for r in rows.values() if len(r)])
    smooth = bayes.SMOOTHING * every.var(axis=0).max()
    within = sum(((r - r.mean(axis=0)) ** 2).sum(axis=0) for r in rows.values() if len(r)) / len(every)
    out = np.full((len(x), 3, len(classes)), -1e300)
    for k, c in enumerate(classes):
        if not len(rows[c]):
            continue
        mean, prior = rows[c].mean(axis=0), np.log(len(rows[c]) / len(every))
        for m, (v, start) in enumerate(((rows[c].var(axis=0) + smooth, prior), (within + smooth, prior), (np.ones(len(mean)), 0.0))):
            out[:, m, k] = start - 0.5 * (np.log(2 * np.pi * v) + (x - mean) ** 2 / v).sum(axis=1)
    return out


@pytest.fixture(scope="module")
def sets():
    rng = np.random.default_rng(4)
    centre = rng.normal(size=(4, 5))
    make = lambda n, start: [(start + i, int(y), (centre[y] + rng.normal(size=5) * (0.3 + 0.4 * y)).tolist()) for i, y in enumerate(rng.integers(0, 4, n))]
    return make(300, 0), make(120, 1000)


def test_scores(spark, sets):
    train, rest = sets
    classes = (0, 1, 2, 3, 7)                                    # 7 has no training rows
    df = spark.createDataFrame(train + [(5000, 1, None), (5001, None, [0.0] * 5)], SCHEMA).repartition(3)
    models = bayes.fit_gaussians(df, classes)
    scored = bayes.score_variants(spark.createDataFrame(rest + [(9000, 0, None)], SCHEMA).repartition(2), models).collect()
    assert len(scored) == 3 * len(rest)
    want = plain(train, np.array([f for _, _, f in rest]), classes)
    place = {i: n for n, (i, _, _) in enumerate(rest)}
    for r in scored:
        w = want[place[r.id], r.model_id]
        assert np.allclose(r.scores[:4], w[:4], rtol=0, atol=1e-8) and r.scores[4] < -1e299
        assert r.y_pred == int(w.argmax()) != 7
    right = [np.mean([r.y_pred == r.label for r in scored if r.model_id == m]) for m in range(3)]
    assert right[0] > 0.6 and min(right) > 0.5


def test_metrics_of_all_models(spark, sets):
    train, rest = sets
    classes = (0, 1, 2, 3, 7)
    models = bayes.fit_gaussians(spark.createDataFrame(train, SCHEMA), classes)
    scored = bayes.score_variants(spark.createDataFrame(rest, SCHEMA).withColumnRenamed("label", "y_true"), models)
    got = {r.model_id: r for r in bayes.metrics_by_model(scored, classes).collect()}
    rows = scored.collect()
    for m in range(3):
        mine = [(r.y_true, r.y_pred) for r in rows if r.model_id == m]
        f1 = []
        for c in classes:
            tp, both = sum(t == p == c for t, p in mine), sum(t == c for t, _ in mine) + sum(p == c for _, p in mine)
            f1.append(2 * tp / both if both else 0.0)
        assert got[m].f1_macro == pytest.approx(np.mean(f1)) and got[m].accuracy == pytest.approx(np.mean([t == p for t, p in mine]))
        assert got[m].n == len(rest)
    best = best_model(bayes.metrics_by_model(scored, classes), metric="f1_macro").first()
    assert best.f1_macro == max(r.f1_macro for r in got.values())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], SCHEMA)
    models = bayes.fit_gaussians(none, (0, 1))
    assert bayes.score_variants(none, models).collect() == []
    assert bayes.metrics_by_model(bayes.score_variants(none.withColumnRenamed("label", "y_true"), models), (0, 1)).collect() == []
