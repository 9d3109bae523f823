"""Operator edge rows and properties (FIXTURES section 3, SURVEY section 5)."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnflow.operators import clean, evaluation, journey, preference, profile, sampling, sequences, sessions
from txnflow.operators.density import kde
from txnflow.operators.smote import knn_within_class, smote, smote_samples


def test_join_fanout_unknown_target_and_null_key(spark):
    j = spark.createDataFrame(
        [("u1", "a1", "t1"), ("u1", "a1", "zz"), ("u1", "a1", None), ("u2", "a2", "t1")],
        "actor_id string, object_id string, target_acct_nbr string")
    for c in journey.JOURNEY_COLUMNS:
        if c not in j.columns:
            j = j.withColumn(c, F.lit(None).cast("long" if c == "action_time" else "string"))
    acc = spark.createDataFrame(
        [("c1", "a1", "I", "P", "2001", 0), ("c9", "a1", "I", "P", "2001", 2), ("c2", "a2", "I", "P", "2001", 1),
         ("ct", "t1", "I", "P", "2001", 0), ("ct2", "t1", "I", "P", "2001", 0), ("cx", "a1", "I", "Q", "2001", 0)],
        "customer_id string, acct_nbr string, customer_class_code string, yyyymm string, start_ym string, label int")
    out = journey.join_accounts(j.select(*journey.JOURNEY_COLUMNS), acc, "P").collect()
    rows = [(r.actor_id, r.target_acct_nbr, r.customer_id, r.target_customer_id) for r in out]
    # a1 has two owners (fan-out x2); t1 has two owners (fan-out x2); zz unknown; null key kept.
    assert sorted(rows, key=str) == sorted([
        ("u1", "t1", "c1", "ct"), ("u1", "t1", "c1", "ct2"), ("u1", "t1", "c9", "ct"), ("u1", "t1", "c9", "ct2"),
        ("u1", "zz", "c1", None), ("u1", "zz", "c9", None), ("u1", None, "c1", None), ("u1", None, "c9", None),
        ("u2", "t1", "c2", "ct"), ("u2", "t1", "c2", "ct2")], key=str)


def test_fill_location(spark):
    df = spark.createDataFrame([("atm_transaction", None), ("mybank_transaction", None), ("atm_transaction", "X")],
                               "event string, atm_location string")
    got = [r[0] for r in clean.fill_location(df, "online", "atm_transaction").select("atm_location").collect()]
    assert got == ["unknown", "online", "X"]


def _plain_sessions(df):
    w = Window.partitionBy("actor_id").orderBy("action_epoch", "event")
    g = F.col("action_epoch") - F.lag("action_epoch").over(w)
    return (df.withColumn("g", F.coalesce(g, F.lit(0)))
              .withColumn("ci", F.sum(F.when(F.col("g") > 86400, 1).otherwise(0))
                          .over(w.rowsBetween(Window.unboundedPreceding, 0))))


def test_gap_sessions_edges(spark):
    rows = [("solo", 100, "a"),
            ("b", 0, "a"), ("b", 86400, "a"), ("b", 2 * 86400 + 1, "a"), ("b", 2 * 86400 + 1, "b")]
    df = spark.createDataFrame(rows, "actor_id string, action_epoch long, event string")
    out = {(r.actor_id, r.action_epoch, r.event): (r.gap_seconds, r.clust_index, r.time_diff)
           for r in sessions.gap_sessions(df).collect()}
    assert out[("solo", 100, "a")] == (0, 0, 0.0)
    assert out[("b", 0, "a")] == (0, 0, 0.0)
    assert out[("b", 86400, "a")] == (86400, 0, 1.0)           # exactly one day: same session
    assert out[("b", 2 * 86400 + 1, "a")][:2] == (86401, 1)   # one day + 1 s: new session
    assert out[("b", 2 * 86400 + 1, "b")][:2] == (0, 1)       # duplicate timestamp


@pytest.mark.parametrize("chunk", [3600, 3 * 86400])
def test_gap_sessions_chunked_equals_plain_window(spark, chunk):
    rng = np.random.default_rng(3)
    t = np.sort(rng.integers(0, 40 * 86400, 600))
    rows = [("hot", int(x), "e") for x in t] + [("cold", int(x), "e") for x in t[::37]]
    df = spark.createDataFrame(rows, "actor_id string, action_epoch long, event string").withColumn(
        "rid", F.monotonically_increasing_id())
    df = df.withColumn("event", F.concat(F.lit("e"), F.col("rid").cast("string")))
    chunked = sessions.gap_sessions(df, chunk_seconds=chunk, tie_breakers=("event",))
    plain = _plain_sessions(df)
    a = sorted((r.rid, r.gap_seconds, r.clust_index) for r in chunked.collect())
    b = sorted((r.rid, r.g, r.ci) for r in plain.collect())
    assert a == b


def test_last_steps_and_padding(spark):
    rows = [("a", i, float(i)) for i in range(2)] + [("b", i, float(i)) for i in range(3)] + \
           [("c", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "actor_id string, action_epoch long, f double").withColumn("label", F.lit(1))
    kept = sequences.last_steps(df, 3, chunk_seconds=2)
    seqs = sequences.pad_sequences(sequences.build_sequences(kept, ["f"]), 3, 1)
    got = {r.actor_id: [s[0] for s in r.x] for r in seqs.collect()}
    assert got == {"a": [0.0, 0.0, 1.0], "b": [0.0, 1.0, 2.0], "c": [2.0, 3.0, 4.0]}
    flat = seqs.select(sequences.flatten("x", "v")).select(sequences.unflatten("v", 3, 1, "y")).collect()
    assert all(len(r.y) == 3 for r in flat)


def test_stratified_split_partition_and_counts(spark):
    rows = [(f"s{i}", 0) for i in range(1)] + [(f"d{i}", 1) for i in range(2)] + \
           [(f"t{i}", 2) for i in range(3)] + [(f"m{i}", 3) for i in range(101)]
    df = spark.createDataFrame(rows, "actor_id string, label int")
    out = sampling.stratified_split(df).collect()
    assert sorted(r.actor_id for r in out) == sorted(r[0] for r in rows)   # a partition: each actor once
    counts = {}
    for r in out:
        counts[(r.label, r.split)] = counts.get((r.label, r.split), 0) + 1
    sizes = {0: 1, 1: 2, 2: 3, 3: 101}
    test = shared_out(sizes, 3, 10)
    val = shared_out({lab: n - test[lab] for lab, n in sizes.items()}, 1, 4)
    for lab, n in sizes.items():
        assert counts.get((lab, "test"), 0) == test[lab]
        assert counts.get((lab, "val"), 0) == val[lab]
        assert counts.get((lab, "train"), 0) == n - test[lab] - val[lab]


def shared_out(sizes, num, den):
    """ceil(num / den) of all, by largest remainder, ties to the smaller label."""
    total = sum(sizes.values())
    wanted = -(-total * num // den)
    out = {lab: n * wanted // total for lab, n in sizes.items()}
    order = sorted(sizes, key=lambda lab: (-(sizes[lab] * wanted % total), lab))
    for lab in order[:wanted - sum(out.values())]:
        out[lab] += 1
    return out


def test_stratified_split_is_global_and_one_per_actor(spark):
    rows = [(f"a{i}", i % 3) for i in range(12)] + [("a0", 2)]
    out = sampling.stratified_split(spark.createDataFrame(rows, "actor_id string, label int")).collect()
    assert sorted((r.actor_id, r.label) for r in out) == sorted(rows)
    per_actor = {}
    for r in out:
        per_actor.setdefault(r.actor_id, set()).add(r.split)
    assert all(len(s) == 1 for s in per_actor.values())
    assert sum(s == {"test"} for s in per_actor.values()) == 4 and sum(s == {"val"} for s in per_actor.values()) == 2
    assert sampling.stratified_split(spark.createDataFrame([], "actor_id string, label int")).collect() == []


def test_null_times_and_actors_stay(spark):
    rows = [("a", 10, "x"), ("a", None, "y"), ("a", 200_000, "z"), (None, 5, "u"), (None, 6, "v")]
    df = spark.createDataFrame(rows, "actor_id string, action_epoch long, event string")
    got = {(r.actor_id, r.action_epoch): (r.gap_seconds, r.clust_index) for r in sessions.gap_sessions(df).collect()}
    assert got == {("a", None): (0, 0), ("a", 10): (0, 0), ("a", 200_000): (199_990, 1), (None, 5): (0, 0), (None, 6): (1, 0)}
    kept = sequences.last_steps(df, 2).collect()
    assert sorted((str(r.actor_id), r.event, r.rank_from_end) for r in kept) == [
        ("None", "u", 2), ("None", "v", 1), ("a", "x", 2), ("a", "z", 1)]


def test_undeclared_classes_stay_in_the_matrix(spark):
    df = spark.createDataFrame([(0, 0), (0, 7), (7, 0), (1, 1), (None, 1)], "y_true int, y_pred int")
    cm = evaluation.confusion_matrix(df, classes=(0, 1)).collect()
    assert sum(r.n for r in cm) == 5 and {(r.y_true, r.y_pred) for r in cm if r.n} == {(0, 0), (0, 7), (7, 0), (1, 1), (None, 1)}
    rep = {r["class"]: r for r in evaluation.classification_report(df, classes=(0, 1)).collect()}
    assert rep["accuracy"].f1_score == 0.4 and rep["7"].support == 1 and rep["7"].recall == 0 and rep["accuracy"].support == 5


def test_wordings_of_any_part_key(spark, tmp_path):
    import datetime
    import os
    spark.createDataFrame([(1, datetime.datetime(2024, 1, 10), 3, "purchase", 5.0, '{"k": 4321}')],
                          "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string") \
        .write.parquet(os.path.join(tmp_path, "events.parquet"))
    spark.createDataFrame([(4321, "SMALL TIN", "name", "brand")], "p_partkey long, p_type string, p_name string, p_brand string") \
        .write.parquet(os.path.join(tmp_path, "part.parquet"))
    from txnflow.sources import testdata
    rows = testdata.journey_event(spark, str(tmp_path), ("202402", "202402")).collect()
    assert [(r.action_type, r.yyyymm) for r in rows] == [("SMALL TIN", "202402")]
    assert testdata.journey_event(spark, str(tmp_path), ("202403", "202403")).collect() == []


def test_exact_rank_matches_window(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("h", sampling.keyed_hash(5, "k"))
    got = sampling.exact_rank(df, ["g"], "h", "k", prefix=1)
    ref = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("h", "k")))
    assert sorted((r.k, r.rank) for r in got.collect()) == sorted((r.k, r.rank) for r in ref.collect())


def test_undersample(spark):
    rows = [(f"a{i}", 0, "train") for i in range(10)] + [(f"b{i}", 2, "train") for i in range(3)] + \
           [(f"c{i}", 1, "train") for i in range(2)] + [(f"v{i}", 0, "val") for i in range(4)]
    out = sampling.undersample(spark.createDataFrame(rows, "actor_id string, label int, split string")).collect()
    train0 = [r for r in out if r.split == "train" and r.label == 0]
    assert len(train0) == 3 and len([r for r in out if r.split == "val"]) == 0
    assert len([r for r in out if r.label in (1, 2)]) == 5


def _vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label int, features array<double>")


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    labels = [i % 2 for i in range(60)]
    rows = [(i, labels[i], x[i].tolist()) for i in range(60)]
    got = knn_within_class(_vectors(spark, rows), k=3, block_size=7).collect()
    got = {(r.id, r.nbr_rank): r.nbr_id for r in got}
    for i in range(60):
        same = [j for j in range(60) if labels[j] == labels[i] and j != i]
        d = sorted((np.linalg.norm(x[i] - x[j]), j) for j in same)[:3]
        assert [got[(i, k + 1)] for k in range(3)] == [j for _, j in d]


def test_smote_balances_and_stays_on_segments(spark):
    rng = np.random.default_rng(1)
    rows = [(i, 0, rng.normal(size=3).tolist()) for i in range(12)]
    rows += [(100 + i, 1, (rng.normal(size=3) + 5).tolist()) for i in range(4)]    # fewer than k+1 members
    rows += [(200, 2, [1.0, 1.0, 1.0]), (201, 2, [1.0, 1.0, 1.0])]                # duplicate points
    df = _vectors(spark, rows)
    out = smote(df, k=5).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in out} == {0: 12, 1: 12, 2: 12}
    pts = {r[0]: np.array(r[2]) for r in rows}
    for r in smote_samples(df, k=5).collect():
        b, n, v = pts[r.base_id], pts[r.nbr_id], np.array(r.features)
        assert np.allclose(v, b + r.u * (n - b))
        assert 0.0 <= r.u < 1.0


def test_smote_already_balanced(spark):
    rows = [(i, i % 2, [float(i), 0.0]) for i in range(6)]
    assert smote_samples(_vectors(spark, rows)).count() == 0


def test_evaluation_edges(spark):
    # Class 2 never predicted; tie in scores -> lowest index.
    rows = [(0, [0.9, 0.1, 0.0]), (0, [0.5, 0.5, 0.0]), (1, [0.1, 0.8, 0.1]), (2, [0.3, 0.6, 0.1])]
    df = evaluation.with_prediction(spark.createDataFrame(rows, "y_true int, scores array<double>"))
    assert [r.y_pred for r in df.collect()] == [0, 0, 1, 1]
    cm = {(r.y_true, r.y_pred): (r.n, r.share) for r in evaluation.confusion_matrix(df).collect()}
    assert len(cm) == 9 and cm[(2, 2)] == (0, None) and cm[(0, 0)] == (2, 1.0) and cm[(2, 1)] == (1, 0.5)
    rep = {r["class"]: r for r in evaluation.classification_report(df).collect()}
    assert rep["2"].precision == 0.0 and rep["2"].recall == 0.0 and rep["2"].f1_score == 0.0
    assert rep["accuracy"].f1_score == 0.75 and rep["accuracy"].support == 4
    assert rep["macro avg"].recall == pytest.approx((1.0 + 1.0 + 0.0) / 3)
    loss = evaluation.cross_entropy(df).first().loss
    s = np.array([r[1] for r in rows])
    ref = np.mean([np.log(np.exp(v).sum()) - v[t] for (t, _), v in zip(rows, s)])
    assert loss == pytest.approx(ref)


def test_preference_tie_breaks(spark):
    rows = [("c1", 1, 1, "cat", "T1", "m2", "Y", 10.0), ("c1", 1, 1, "cat", "T1", "m1", "Y", 10.0),
            ("c1", 1, 1, "cat", "T2", "m3", "Y", 20.0)] + \
           [("c1", 2, 2, "cat", "T1", "m1", "Y", 1.0)] * 10
    cons = spark.createDataFrame(rows, "customer_id string, week int, dayofweek int, consumption_category_desc string,"
                                       " loc_type_town string, merchant_name string, merchant_flag string, txn_amt double")
    out = preference.merchant_preference(cons, (1, 8), (0, 8), 10).collect()
    got = {(r.dayofweek, r.loc_type_town): r.merchant_name for r in out}
    # Day 1: T2 (count 1, amount 20) loses to T1 (count 2); within T1, m1 (11 rows) ranks first.
    assert got == {(1, "T1"): "m1", (2, "T1"): "m1"}


def test_profiles_edges(spark):
    rows = [("solo", 1, "self", 0.0, "TWD", "L", "t", "a", 0, 0, "e1", 0.0, 1),
            ("z", 0, "self", 0.0, None, "L", "t", "a", 1, 0, "e1", 0.0, 1),
            ("z", 0, "self", 0.0, "TWD", "L", "t", "a", 0, 1, "e2", 0.5, 1),
            ("z", 0, "others", 0.0, "USD", "M", "u", "b", 0, 0, "e1", 0.0, 1),
            ("ghost", 2, "others", 5.0, "TWD", "L", "t", "a", 0, 0, "e1", 0.0, 1)]
    df = spark.createDataFrame(rows, "actor_id string, label int, action_sponsor string, twd_amt double, "
                                     "txn_currency_code string, atm_location string, target_acct_nbr string, "
                                     "acct_nbr string, isCrossBank int, isSelfTrans int, event string, "
                                     "time_diff double, cash_flow int")
    p = {r.actor_id: r for r in profile.actor_profile(df).collect()}
    assert "ghost" not in p                                               # no own rows: not profiled
    assert p["solo"].twdAmt_cov == 0.0 and p["z"].twdAmt_cov == 0.0      # 0/0 -> 0
    assert p["z"].currency_uniqueNum == 2                                 # own rows: null counted as a value
    assert p["z"].atmLocation_uniqueNum == 1                              # the others row is not counted
    assert p["z"].sponsor_multiply == 2 and p["z"].isCrossBank_01multiply == 1
    assert p["z"].isSelfTrans_sum == 1
    approx = {r.actor_id: r for r in profile.actor_profile(df, approximate_distinct=True).collect()}
    assert approx["z"].currency_uniqueNum == 2 and approx["solo"].atmLocation_uniqueNum == 1
    c = {r.actor_id: r for r in profile.conditional_profile(df.filter("action_sponsor = 'self'")).collect()}
    assert c["solo"].cov_timeDiff_allTrans is None                        # sample std of one row
    assert c["z"].kindsOfEvent == 2 and c["z"].avg_timeDiff_zeroTrans == 0.25


def test_kde_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    vals = np.round(rng.normal(100, 30, 40), 1)
    rows = [(int(i % 2), float(v)) for i, v in enumerate(vals)]
    out = kde(spark.createDataFrame(rows, "g int, v double"), "v", "g").collect()
    for g in (0, 1):
        xs = np.array([v for gg, v in rows if gg == g])
        n, sd = len(xs), xs.std(ddof=1)
        bw = sd * n ** -0.2
        rng_ = xs.max() - xs.min()
        grid = np.linspace(xs.min() - 0.5 * rng_, xs.max() + 0.5 * rng_, 1000)
        ref = np.exp(-0.5 * ((grid[:, None] - xs[None, :]) / bw) ** 2).sum(1) / (n * bw * np.sqrt(2 * np.pi))
        got = sorted((r.grid_idx, r.density) for r in out if r.g == g)
        assert len(got) == 1000
        assert np.allclose([d for _, d in got], ref, rtol=1e-9, atol=1e-15)


def test_level_pca_matches_numpy(spark):
    from txnflow.operators.text_features import fit_pca, one_hot_vector, project_levels
    levels = ["p", "q", "r", "s"]
    rng = np.random.default_rng(4)
    values = [levels[i] for i in rng.choice(4, 80, p=[0.5, 0.3, 0.15, 0.05])]
    df = spark.createDataFrame(list(enumerate(values)), "id int, level string")
    fit = fit_pca(df.select(one_hot_vector(F.col("level"), levels).alias("v")), "v", 3)
    out = df.select("id", *project_levels(F.col("level"), levels, fit, 3, "p")).orderBy("id").collect()
    x = np.array([[float(v == lv) for lv in levels] for v in values])
    xc = x - x.mean(0)
    w, v = np.linalg.eigh(np.cov(xc, rowvar=False))
    v = v[:, np.argsort(w)[::-1]][:, :3]
    v *= np.where(v[np.abs(v).argmax(0), range(3)] < 0, -1, 1)
    assert np.allclose([[r.p0, r.p1, r.p2] for r in out], xc @ v, atol=1e-8)
    assert np.allclose(fit.explained_ratio, np.sort(w)[::-1][:3] / w.sum())


@pytest.mark.parametrize("weighted,block,columns", [(False, 24, 480), (True, 40, 480), (False, 3, 480), (True, 4, 14)])
def test_text_pca_matches_numpy(spark, monkeypatch, weighted, block, columns):
    """The whole vocabulary, in several blocks, also when steps are many and the space is restarted."""
    from txnflow.operators import text_pca
    for name, value in (("BLOCK", block), ("MOST_COLUMNS", columns), ("DOC_CELLS", 100), ("TERM_BLOCK", 7), ("CHUNK", 20)):
        monkeypatch.setattr(text_pca, name, value)
    rng = np.random.default_rng(5)
    words = [f"t{i}" for i in range(30)]
    share = 0.5 ** np.arange(30) + 0.02
    docs = [(f"d{i}", int(rng.integers(1, 4)) if weighted else 1, [words[j] for j in rng.choice(30, rng.integers(0, 40), p=share / share.sum())])
            for i in range(60)]
    df = spark.createDataFrame(docs, "doc string, w int, terms array<string>")
    counts, n = text_pca.term_counts(df, "doc", "terms", "w", 2, 0.97)
    fit = text_pca.fit_text_pca(counts, n, 3)
    out = text_pca.project_documents(df, "doc", counts, fit, 4, "p").collect()
    x = np.array([[t.count(v) for v in words] for _, w, t in docs for _ in range(w)], dtype=float)
    df_ = (x > 0).sum(0)
    x = x[:, (df_ >= 2) & (df_ <= 0.97 * n)]
    xc = x - x.mean(0)
    _, s, vt = np.linalg.svd(xc, full_matrices=False)
    v = vt[:3].T * np.where(vt[range(3), np.abs(vt[:3]).argmax(1)] < 0, -1, 1)
    want = dict(zip([d for d, w, _ in docs for _ in range(w)], xc @ v))
    assert n == len(x) and x.shape[1] > 6
    for r in out:
        assert np.allclose([r.p0, r.p1, r.p2], want[r.doc], atol=1e-5) and r.p3 == 0.0
    assert np.allclose(fit.explained_ratio, s[:3] ** 2 / (s ** 2).sum(), atol=1e-9)


def test_text_pca_sends_few_terms_to_every_task(spark, monkeypatch):
    """Counts stay where they are stored while the directions are small; both ways give the same components."""
    import random
    from txnflow.operators import text_pca
    rng = random.Random(2)
    rows = [(i, [f"t{rng.randrange(6) * rng.randrange(6)}" for _ in range(rng.randrange(40))]) for i in range(80)]
    df = spark.createDataFrame(rows, "doc long, terms array<string>").repartition(3)
    counts, n = text_pca.term_counts(df, "doc", "terms", None, 2, 0.97)
    monkeypatch.setattr(text_pca, "DOC_CELLS", 100)
    monkeypatch.setattr(text_pca, "TERM_BLOCK", 5)
    real = text_pca._through
    monkeypatch.setattr(text_pca, "_through", None)
    near = text_pca.fit_text_pca(counts, n, 3)
    monkeypatch.setattr(text_pca, "_through", real)
    monkeypatch.setattr(text_pca, "SENT_BYTES", 0)
    far = text_pca.fit_text_pca(counts, n, 3)
    assert near.variances == pytest.approx(far.variances, rel=1e-9) and near.total == far.total
    a, b = ({r.term: r.v for r in f.loadings.collect()} for f in (near, far))
    assert a.keys() == b.keys() and all(a[t] == pytest.approx(b[t], abs=1e-6) for t in a)
    moments, m = text_pca.kept_term_moments(df, "doc", "terms", 2, 0.97)
    assert m == n and sorted(map(tuple, moments.collect())) == sorted(map(tuple, text_pca.term_moments(counts, n).collect()))


def test_text_pca_of_nothing(spark):
    from txnflow.operators import text_pca
    df = spark.createDataFrame([("a", None), ("b", [])], "doc string, terms array<string>")
    counts, n = text_pca.term_counts(df, "doc", "terms")
    fit = text_pca.fit_text_pca(counts, n, 3)
    assert fit.explained_ratio == () and [r.p0 for r in text_pca.project_documents(df, "doc", counts, fit, 1, "p").collect()] == [0.0, 0.0]


def test_best_model_and_classifier(spark):
    from txnflow.operators.classifier import score, train_best
    m = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.7)], "model_id int, val_f1 double")
    assert evaluation.best_model(m).first()["model_id"] == 1
    rng = np.random.default_rng(6)
    rows = [(i, i % 3, (rng.normal(size=4) + 3 * (i % 3)).tolist()) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, features array<double>")
    model, metrics = train_best(df, df, reg_params=(0.0, 0.1))
    assert metrics.count() == 2
    acc = score(model, df).filter(F.col("y_pred") == F.col("label")).count() / 90
    assert acc > 0.9


def test_pad_long_equals_array_padding(spark):
    rows = [("a", i, float(i)) for i in range(2)] + [("c", i, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "actor_id string, action_epoch long, f double").withColumn("label", F.lit(1))
    long = sorted((r.actor_id, r.step, r.f) for r in sequences.pad_long(df, 3, ["f"], chunk_seconds=2).collect())
    assert long == [("a", 0, 0.0), ("a", 1, 0.0), ("a", 2, 1.0), ("c", 0, 2.0), ("c", 1, 3.0), ("c", 2, 4.0)]


def test_confusion_counts_sum_to_rows(spark):
    rng = np.random.default_rng(7)
    rows = [(int(rng.integers(0, 3)), rng.normal(size=3).tolist()) for _ in range(200)]
    df = evaluation.with_prediction(spark.createDataFrame(rows, "y_true int, scores array<double>"))
    cm = evaluation.confusion_matrix(df).collect()
    assert len(cm) == 9 and sum(r.n for r in cm) == 200


def test_scaler_mean_zero_population_std_one(spark):
    from txnflow.operators.scaling import standardize_all
    rng = np.random.default_rng(8)
    x = rng.normal(50, 7, 300)
    df = spark.createDataFrame([(float(v), 3.0) for v in x], "a double, c double")
    out = standardize_all(df, ["a", "c"])
    a = np.array([r.a_scaled for r in out.collect()])
    assert abs(a.mean()) < 1e-12 and abs(a.std(ddof=0) - 1.0) < 1e-12
    assert {r.c_scaled for r in out.collect()} == {0.0}          # constant column: scale 1, values 0


def test_knn_high_dimension_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(50, 400))
    x[7] = x[3]                                   # an exact duplicate: distance 0, tie by id
    rows = [(i, 0, x[i].tolist()) for i in range(50)]
    got = knn_within_class(_vectors(spark, rows), k=4, block_size=16).collect()
    got = {(r.id, r.nbr_rank): (r.nbr_id, r.distance) for r in got}
    for i in range(50):
        d = sorted((float(np.sqrt(((x[i] - x[j]) ** 2).sum())), j) for j in range(50) if j != i)[:4]
        assert [got[(i, k + 1)][0] for k in range(4)] == [j for _, j in d]
        assert np.allclose([got[(i, k + 1)][1] for k in range(4)], [v for v, _ in d], rtol=0, atol=1e-12)
