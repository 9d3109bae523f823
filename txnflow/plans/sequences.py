"""Entry 2, stage 2 queries: sessions, scaling, sequence lengths, padded sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.domain import NON_PCA_FEATURES
from txnflow.operators.scaling import standardize_all
from txnflow.operators.sequences import max_timestep, pad_long, steps_per_actor
from txnflow.operators.sessions import gap_sessions, session_sizes
from txnflow.plans.features import features
from txnflow.plans.registry import register
from txnflow.plans.sql import CTE, FEATURES, with_ctes
from txnflow.session import cut_lineage

TIES = ["event", "twd_amt", "action_type", "txn_type_desc", "atm_location", "target_acct_nbr", "acct_nbr",
        "customer_id", "label"]
ORDER_ASC = ", ".join(["action_epoch"] + [f"{c} ASC NULLS FIRST" for c in TIES])
ORDER_DESC = ", ".join(["action_epoch DESC"] + [f"{c} DESC NULLS LAST" for c in TIES])

CTE["sess0"] = f"""
SELECT *, action_epoch - lag(action_epoch) OVER (PARTITION BY actor_id ORDER BY {ORDER_ASC}) AS g FROM features
"""
CTE["sessioned"] = f"""
SELECT * EXCLUDE (g), CAST(coalesce(g, 0) AS BIGINT) AS gap_seconds,
  CAST(sum(CASE WHEN g > 86400 THEN 1 ELSE 0 END) OVER (PARTITION BY actor_id ORDER BY {ORDER_ASC}
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS INTEGER) AS clust_index,
  round_even(coalesce(g, 0) / 86400.0 * 10000.0, 0) / 10000.0 AS time_diff
FROM sess0
"""
CTE["scaled"] = """
SELECT *,
  (twd_amt - (SELECT avg(twd_amt) FROM sessioned))
    / (SELECT CASE WHEN coalesce(stddev_pop(twd_amt), 0) > 0 THEN stddev_pop(twd_amt) ELSE 1 END FROM sessioned)
    AS twd_amt_scaled,
  (time_diff - (SELECT avg(time_diff) FROM sessioned))
    / (SELECT CASE WHEN coalesce(stddev_pop(time_diff), 0) > 0 THEN stddev_pop(time_diff) ELSE 1 END FROM sessioned)
    AS time_diff_scaled
FROM sessioned
"""
CTE["tmax"] = """
SELECT max(steps) AS t FROM (SELECT actor_id, label, count(*) AS steps FROM features GROUP BY 1, 2) s
WHERE label <> 0
"""
SEQ = FEATURES + ["sess0", "sessioned", "scaled", "tmax"]


KEYS = ["actor_id", "action_epoch", *TIES]


def sessioned(spark, sf_dir, columns=()):
    """Sessions with the ordering columns and ``columns``.

    The sessions operator reads its input in two branches (rows, chunk carry); those columns, and no others,
    are materialised once so that the extraction runs a single time.
    """
    rows = features(spark, sf_dir)
    return gap_sessions(cut_lineage(rows.select([c for c in rows.columns if c in {*KEYS, *columns}])))


def scaled(spark, sf_dir, columns=()):
    # Read by the scaler fit, the max-length scalar and the main plan.
    return standardize_all(cut_lineage(sessioned(spark, sf_dir, columns)), ["twd_amt", "time_diff"])


@register("gap_sessions", bench=True, sql=with_ctes(SEQ[:-2], """
SELECT actor_id, action_epoch, event, gap_seconds, time_diff, clust_index FROM sessioned"""))
def q_gap_sessions(spark, sf_dir):
    return sessioned(spark, sf_dir).select("actor_id", "action_epoch", "event", "gap_seconds", "time_diff",
                                           "clust_index")


@register("session_sizes", sql=with_ctes(SEQ[:-2], """
SELECT actor_id, clust_index, count(*) AS n_rows, min(action_epoch) AS first_time, max(action_epoch) AS last_time
FROM sessioned GROUP BY actor_id, clust_index"""))
def q_session_sizes(spark, sf_dir):
    return session_sizes(sessioned(spark, sf_dir))


@register("scale_amount", sql=with_ctes(SEQ[:-1], """
SELECT actor_id, action_epoch, event, twd_amt, round(twd_amt_scaled, 6) AS twd_amt_scaled,
       time_diff, round(time_diff_scaled, 6) AS time_diff_scaled FROM scaled"""))
def q_scale_amount(spark, sf_dir):
    return scaled(spark, sf_dir).select(
        "actor_id", "action_epoch", "event", "twd_amt", F.round("twd_amt_scaled", 6).alias("twd_amt_scaled"),
        "time_diff", F.round("time_diff_scaled", 6).alias("time_diff_scaled"))


@register("sequence_lengths", sql=with_ctes(SEQ, """
SELECT actor_id, label, count(*) AS steps, (SELECT t FROM tmax) AS max_timestep
FROM features GROUP BY actor_id, label"""))
def q_sequence_lengths(spark, sf_dir):
    df = cut_lineage(features(spark, sf_dir).select("actor_id", "label"))   # read by the max-length scalar and the output
    T = max_timestep(df)
    return steps_per_actor(df).withColumn("max_timestep", F.lit(T).cast("long"))


_FEATS = ", ".join(f'round(CAST(coalesce(k."{f}", 0) AS DOUBLE), 6) AS "{f}"' for f in NON_PCA_FEATURES)


@register("padded_sequences", bench=True, sql=with_ctes(SEQ, f"""
, actors AS (SELECT DISTINCT actor_id, label FROM features),
ranked AS (SELECT *, row_number() OVER (PARTITION BY actor_id ORDER BY {ORDER_DESC}) AS rfe FROM scaled),
kept AS (SELECT * FROM ranked WHERE rfe <= (SELECT t FROM tmax))
SELECT a.actor_id, a.label, CAST(s.step AS INTEGER) AS step, {_FEATS}
FROM actors a
CROSS JOIN (SELECT unnest(range(0, (SELECT t FROM tmax))) AS step) s
LEFT JOIN kept k ON k.actor_id = a.actor_id AND (SELECT t FROM tmax) - k.rfe = s.step
""".replace("\n, actors", ",\nactors")))
def q_padded_sequences(spark, sf_dir):
    df = scaled(spark, sf_dir, NON_PCA_FEATURES)
    rows = pad_long(df, max_timestep(df), NON_PCA_FEATURES)
    return rows.select("actor_id", "label", "step", *[F.round(f"`{f}`", 6).alias(f) for f in NON_PCA_FEATURES])
