"""Model-table queries: full feature table, training tensor, density, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.domain import MODEL_FEATURES, NON_PCA_FEATURES, TESTDATA_DOMAIN
from txnflow.operators.classifier import score, train_best
from txnflow.operators.density import kde, kde_groups
from txnflow.operators.features import DROPPED_BEFORE_MODEL, model_columns
from txnflow.operators.sampling import stratified_split
from txnflow.operators.smote import smote
from txnflow.operators.scaling import standardize_all
from txnflow.operators.sequences import build_sequences, flatten, last_steps, max_timestep, pad_sequences
from txnflow.operators.step_blocks import flatten_block, padded_blocks
from txnflow.operators.text_features import fit_pca, one_hot_vector, project_levels
from txnflow.operators.text_pca import fit_text_pca, project_documents, term_counts
from txnflow.functions import flags, text
from txnflow.plans.features import features
from txnflow.plans.registry import register
from txnflow.plans.sequences import SEQ, scaled, sessioned
from txnflow.plans.sql import CTE, FEATURES, with_ctes
from txnflow.session import cut_lineage
from txnflow.sources import testdata as td


def full_features(spark, sf_dir, columns=NON_PCA_FEATURES, domain=TESTDATA_DOMAIN):
    """Per-transaction features: ``columns``, PCA projections and scaled columns."""
    # Many passes follow (two PCA fits, means, scalers): compute the rows once.
    df = cut_lineage(sessioned(spark, sf_dir, [*columns, "cat_action", "location_doc"]))
    # Each distinct location is one document that stands for all its rows.
    places = df.groupBy("location_doc").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_terms", text.analyse(F.col("location_doc")))
    counts, n = term_counts(places, "location_doc", "_terms", "_rows", 0.001, 0.99)
    loc_fit = fit_text_pca(counts, n, 10)
    levels = [r.label for r in domain.action_rules] + [domain.action_default]
    cat_fit = fit_pca(df.select(one_hot_vector(F.col("cat_action"), levels).alias("_cat_vec")), "_cat_vec", 10)
    df = project_documents(df, "location_doc", counts, loc_fit, 5, "location_token_")
    df = df.select("*", *project_levels(F.col("cat_action"), levels, cat_fit, 4, "cat_action_"))
    df = standardize_all(df, ["twd_amt", "time_diff"])
    return df.drop("location_doc")


@register("txn_features")
def q_txn_features(spark, sf_dir):
    """Rows-only: the model feature table (one row per transaction)."""
    columns = set(features(spark, sf_dir).columns) - set(DROPPED_BEFORE_MODEL)
    return model_columns(full_features(spark, sf_dir, columns))


@register("level_pca_checks", sql=with_ctes(FEATURES, """
, p AS (SELECT cat_action, count(*) / (SELECT count(*) FROM features) AS p FROM features GROUP BY cat_action)
SELECT CAST(component AS INTEGER) AS component, CAST(1 AS DOUBLE) AS norm, CAST(0 AS DOUBLE) AS residual, CAST(0 AS DOUBLE) AS score_mean,
  CAST(1 AS DOUBLE) AS score_variance,
  (SELECT round(sum(p * (1 - p)) * (SELECT count(*) / (count(*) - 1) FROM features), 6) FROM p) AS total_variance
FROM (SELECT unnest(range(least(4, (SELECT count(*) - 1 FROM p)))) AS component)""".replace("\n, p AS", ",\np AS")))
def q_level_pca_checks(spark, sf_dir):
    """The components of the action levels against their closed-form covariance, and the projected rows.

    Shares p of the levels give the covariance (diag(p) - p p') n / (n - 1); the levels' scores have mean 0 and the
    variance that the fit states.
    """
    df = cut_lineage(features(spark, sf_dir).select("cat_action"))
    levels = [r.label for r in TESTDATA_DOMAIN.action_rules] + [TESTDATA_DOMAIN.action_default]
    fit = fit_pca(df.select(one_hot_vector(F.col("cat_action"), levels).alias("v")), "v", 10)
    keep = [j for j in range(min(4, len(fit.variances))) if fit.variances[j] > 1e-9]
    n = df.count()
    shares = df.groupBy("cat_action").agg((F.count(F.lit(1)) / F.lit(float(n))).alias("p"))           # one row a level
    loading = [F.element_at(F.create_map(*[F.lit(x) for i, lv in enumerate(levels) for x in (lv, float(fit.components[i, j]))]), F.col("cat_action"))
               for j in keep]
    placed = spark.createDataFrame([(lv,) for lv in levels], "cat_action string").join(shares, "cat_action", "left").fillna(0.0) \
        .select("p", *[c.alias(f"v{j}") for j, c in zip(keep, loading)])
    inner = placed.agg(*[F.sum(F.col("p") * F.col(f"v{j}")).alias(f"m{j}") for j in keep])
    scale = n / max(n - 1, 1)
    off = [F.sqrt(F.sum(F.pow(scale * F.col("p") * (F.col(f"v{j}") - F.col(f"m{j}")) - fit.variances[j] * F.col(f"v{j}"), 2))) for j in keep]
    norm = [F.sqrt(F.sum(F.pow(F.col(f"v{j}"), 2))) for j in keep]
    table = placed.join(F.broadcast(inner)).agg(*[x.alias(f"off{j}") for j, x in zip(keep, off)], *[x.alias(f"norm{j}") for j, x in zip(keep, norm)])
    scored = df.select(*project_levels(F.col("cat_action"), levels, fit, len(keep), "s"))
    moments = scored.agg(*[f(F.col(f"s{j}")).alias(f"{name}{j}") for j in keep for f, name in ((F.avg, "mean"), (F.var_samp, "var"))])
    rows = F.array(*[F.struct(F.lit(j).alias("component"), F.round(f"norm{j}", 6).alias("norm"), F.round(f"off{j}", 6).alias("residual"),
                              F.round(F.abs(f"mean{j}"), 6).alias("score_mean"),
                              F.round(F.col(f"var{j}") / fit.variances[j], 6).alias("score_variance")) for j in keep])
    return table.join(F.broadcast(moments)).select(F.inline(rows)).withColumn("total_variance", F.round(F.lit(fit.total), 6))


MODEL_TABLE = ["actor_id", "label", "isCrossBank", "isSelfTrans", "isExchangeDeal", "action_time", "action_time_month",
               "action_time_day", "action_time_hour", "action_time_dayOfWeek", "action_time_isWeekend_1",
               "action_time_periodOfDay_1", "action_time_periodOfDay_2", "action_time_periodOfDay_3",
               "event_atm_transaction", "event_myatm_transaction", "cash_flow_-1", "cash_flow_1", "twd_amt", "time_diff", "clust_index"]
_SCALED = ["twd_amt_scaled", "time_diff_scaled"]


@register("model_table", sql=with_ctes(SEQ[:-1], "SELECT " + ", ".join(f'"{c}"' for c in MODEL_TABLE) + ", "
          + ", ".join(f"round({c}, 6) AS {c}" for c in _SCALED) + " FROM scaled"))
def q_model_table(spark, sf_dir):
    """The model feature table but for its PCA projections, which the tests hold against numpy."""
    columns = set(features(spark, sf_dir).columns) - set(DROPPED_BEFORE_MODEL)
    return model_columns(scaled(spark, sf_dir, columns)).select(
        *[F.col(f"`{c}`") for c in MODEL_TABLE], *[F.round(c, 6).alias(c) for c in _SCALED])


@register("training_tensor")
def q_training_tensor(spark, sf_dir):
    """Rows-only: padded blocks of 22 features a step with their split, flattened; ``tensor_blocks`` has SQL for 13 of them."""
    df = full_features(spark, sf_dir)
    T = max_timestep(df)
    split = stratified_split(df.select("actor_id", "label").distinct())
    return padded_blocks(df, MODEL_FEATURES, T).join(split, ["actor_id", "label"]).select(
        "actor_id", "label", "split", "block", F.lit(T).alias("timesteps"), flatten_block().alias("features"))


CTE["density_in"] = """
SELECT label, actor_id, sum(CASE WHEN cash_flow = -1 THEN -twd_amt ELSE twd_amt END) AS v
FROM sessioned GROUP BY label, actor_id
"""
CTE["density"] = """
WITH st AS (SELECT label, count(v) AS n, min(v) AS mn, max(v) AS mx, stddev_samp(v) AS sd FROM density_in
            GROUP BY label HAVING stddev_samp(v) > 0),
p AS (SELECT label, n, mn - 0.5 * (mx - mn) AS lo,
        ((mx + 0.5 * (mx - mn)) - (mn - 0.5 * (mx - mn))) / 999 AS step, sd * pow(n, -0.2) AS bw FROM st),
g AS (SELECT p.*, r.i AS grid_idx, p.lo + r.i * p.step AS x FROM p, (SELECT unnest(range(1000)) AS i) r)
SELECT g.label, g.grid_idx, g.x,
  sum(exp(-0.5 * pow((g.x - d.v) / g.bw, 2))) / (g.n * g.bw * sqrt(2 * pi())) AS density
FROM g JOIN density_in d ON d.label = g.label GROUP BY g.label, g.grid_idx, g.x, g.n, g.bw
"""


def _totals(spark, sf_dir, by):
    """Each actor's signed amounts, added up, by ``by``."""
    s = sessioned(spark, sf_dir, ["cash_flow"])
    return cut_lineage(s.groupBy(*by).agg(F.sum(flags.signed_amount(F.col("cash_flow"), F.col("twd_amt"))).alias("v")))   # read twice by kde


@register("density_groups", sql=with_ctes(SEQ[:-2], """
, per AS (SELECT actor_id, clust_index, sum(CASE WHEN cash_flow = -1 THEN -twd_amt ELSE twd_amt END) AS v FROM sessioned GROUP BY 1, 2),
st AS (SELECT actor_id, count(v) AS n, min(v) AS lo, max(v) AS hi FROM per GROUP BY actor_id)
SELECT actor_id, n, lo, hi, CASE WHEN n = 0 THEN 'no values' WHEN n = 1 THEN 'one value' WHEN hi > lo THEN 'density' ELSE 'no spread' END AS status
FROM st""".replace("\n, per", ",\nper")))
def q_density_groups(spark, sf_dir):
    """Which actors' session totals have a density, and why the others have none."""
    totals = _totals(spark, sf_dir, ["actor_id", "clust_index"])
    return kde_groups(totals, "v", "actor_id").drop("sd")


@register("amount_density", sql=with_ctes(SEQ[:-2] + ["density_in", "density"], """
SELECT label, grid_idx, x, round(density, 12) AS density FROM density"""))
def q_amount_density(spark, sf_dir):
    totals = _totals(spark, sf_dir, ["label", "actor_id"])
    out = kde(totals, "v", "label")
    return out.select("label", "grid_idx", "x", F.round("density", 12).alias("density"))


@register("train_score")
def q_train_score(spark, sf_dir):
    """Rows-only: logistic regression on embedding vectors (ten classes), best of 3, test rows scored."""
    v = td.vectors(spark, sf_dir)
    split = stratified_split(v.select("id", "label"), key="id")
    data = cut_lineage(v.join(split.select("id", "split"), "id"))     # read by three fits and the scoring
    model, _ = train_best(data.filter(F.col("split") == "train"), data.filter(F.col("split") == "val"), n_classes=10)
    scored = score(model, data.filter(F.col("split") == "test"))
    return scored.select("id", F.col("label").alias("y_true"), "y_pred", "scores")


@register("sequence_model_scores")
def q_sequence_model_scores(spark, sf_dir):
    """Rows-only: the original's train/evaluate flow on the padded sequence tensor.

    Padded T x 22 sequences -> exact stratified split -> SMOTE on the training
    split -> logistic regression per regularisation strength, best by
    validation macro F1 -> test actors scored.
    """
    df = full_features(spark, sf_dir)
    T = max_timestep(df)
    seqs = pad_sequences(build_sequences(last_steps(df, T), MODEL_FEATURES), T, len(MODEL_FEATURES))
    split = stratified_split(df.select("actor_id", "label").distinct())
    data = cut_lineage(seqs.join(split, ["actor_id", "label"]).select(
        F.concat_ws("|", "actor_id", "label").alias("id"), "actor_id", "label", "split", flatten("x", "features")))
    # Read by three fits: computed once.
    train = cut_lineage(smote(data.filter(F.col("split") == "train").select("id", "label", "features")))
    model, _ = train_best(train, data.filter(F.col("split") == "val"))
    scored = score(model, data.filter(F.col("split") == "test"))
    return scored.select("actor_id", F.col("label").alias("y_true"), "y_pred", "scores")
