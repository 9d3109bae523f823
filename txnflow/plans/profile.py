"""Entry 2, stage 3 queries: actor profiles, conditional profiles, weekend share, null counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.domain import TESTDATA_DOMAIN
from txnflow.operators.clean import clean
from txnflow.operators.features import transaction_flags
from txnflow.operators.profile import actor_profile, conditional_profile, null_counts, weekend_share
from txnflow.plans.extract import joined
from txnflow.plans.features import features
from txnflow.plans.registry import register
from txnflow.plans.sequences import SEQ, sessioned
from txnflow.plans.sql import BASE, CTE, FEATURES, with_ctes
from txnflow.operators.journey import JOINED_COLUMNS

CTE["cleaned_all"] = CTE["cleaned"].replace(" AND action_sponsor = 'self'", "")
CTE["profile_in"] = """
SELECT *,
  CASE WHEN coalesce(target_bank_code <> '013', TRUE) THEN 1 ELSE 0 END AS isCrossBank,
  CASE WHEN coalesce(actor_id = target_customer_id, FALSE) AND coalesce(acct_nbr <> target_acct_nbr, TRUE)
       THEN 1 ELSE 0 END AS isSelfTrans
FROM cleaned_all
"""


def profile_input(spark, sf_dir):
    """Cleaned rows of both sponsors (the sponsor product needs both), with flags."""
    return transaction_flags(clean(joined(spark, sf_dir), TESTDATA_DOMAIN, sponsor=None), TESTDATA_DOMAIN)


PROFILE_DOUBLES = ("twdAmt_cov",)


def _own_distinct(c):
    return (f"count(DISTINCT CASE WHEN action_sponsor = 'self' THEN {c} END)"
            f" + max(CASE WHEN action_sponsor = 'self' AND {c} IS NULL THEN 1 ELSE 0 END)")


@register("actor_profile", bench=True, sql=with_ctes(BASE + ["cleaned", "cleaned_all", "profile_in"], f"""
, prof AS (
  SELECT actor_id,
    avg(CASE WHEN action_sponsor = 'self' THEN twd_amt END) AS twdAmt_avg,
    stddev_pop(CASE WHEN action_sponsor = 'self' THEN twd_amt END)
      / nullif(avg(CASE WHEN action_sponsor = 'self' THEN twd_amt END), 0) AS twdAmt_cov,
    CAST(count_if(action_sponsor = 'self') * count_if(action_sponsor = 'others') AS BIGINT) AS sponsor_multiply,
    {_own_distinct('txn_currency_code')} AS currency_uniqueNum,
    {_own_distinct('atm_location')} AS atmLocation_uniqueNum,
    {_own_distinct('target_acct_nbr')} AS targetAcct_uniqueNum,
    {_own_distinct('acct_nbr')} AS acct_uniqueNum,
    CAST(count_if(action_sponsor = 'self' AND isCrossBank = 0) * count_if(action_sponsor = 'self' AND isCrossBank = 1)
         AS BIGINT) AS isCrossBank_01multiply,
    CAST(sum(CASE WHEN action_sponsor = 'self' THEN isSelfTrans END) AS BIGINT) AS isSelfTrans_sum
  FROM profile_in GROUP BY actor_id HAVING count_if(action_sponsor = 'self') > 0),
labels AS (SELECT DISTINCT actor_id, label FROM profile_in WHERE action_sponsor = 'self')
SELECT p.actor_id, coalesce(p.twdAmt_avg, 0) AS twdAmt_avg, round(coalesce(p.twdAmt_cov, 0), 6) AS twdAmt_cov,
  p.sponsor_multiply, p.currency_uniqueNum, p.atmLocation_uniqueNum, p.targetAcct_uniqueNum, p.acct_uniqueNum,
  p.isCrossBank_01multiply, coalesce(p.isSelfTrans_sum, 0) AS isSelfTrans_sum, coalesce(l.label, 0) AS label
FROM prof p LEFT JOIN labels l ON p.actor_id = l.actor_id
""".replace("\n, prof", ",\nprof")))
def q_actor_profile(spark, sf_dir):
    prof = actor_profile(profile_input(spark, sf_dir))
    return prof.select(*[F.round(c, 6).alias(c) if c in PROFILE_DOUBLES else F.col(c) for c in prof.columns])


# Only values from floating-point algorithms (standard deviations) are rounded for
# comparison; means of exact sums and ratios of counts are the same double in any
# engine, and rounding them could only introduce half-way disagreements.
COND_DOUBLES = ("cov_timeDiff_allTrans", "cov_timeDiff_zeroTrans", "cov_timeDiff_cashTrans",
                "cov_twdAmt_allTrans", "cov_twdAmt_allCashTrans")


def _cv(x, mean=None):
    return f"stddev_samp({x}) / nullif({mean or f'avg({x})'}, 0)"


def _exact_avg(x):
    return f"CAST(sum(CAST({x} AS DECIMAL(38, 4))) AS DOUBLE) / nullif(count({x}), 0)"


_Z, _C = "CASE WHEN twd_amt = 0 THEN {} END", "CASE WHEN twd_amt <> 0 THEN {} END"
_COND_SQL = {
    "true_amt_sum": "sum(CASE WHEN cash_flow = -1 THEN -twd_amt ELSE twd_amt END)",
    "avg_timeDiff_allTrans": _exact_avg("time_diff"),
    "cov_timeDiff_allTrans": _cv("time_diff", _exact_avg("time_diff")),
    "avg_timeDiff_zeroTrans": _exact_avg(_Z.format("time_diff")),
    "cov_timeDiff_zeroTrans": _cv(_Z.format("time_diff"), _exact_avg(_Z.format("time_diff"))),
    "avg_timeDiff_cashTrans": _exact_avg(_C.format("time_diff")),
    "cov_timeDiff_cashTrans": _cv(_C.format("time_diff"), _exact_avg(_C.format("time_diff"))),
    "avg_twdAmt_allTrans": "avg(twd_amt)",
    "cov_twdAmt_allTrans": _cv("twd_amt"),
    "avg_twdAmt_allCashTrans": f"avg({_C.format('twd_amt')})",
    "cov_twdAmt_allCashTrans": _cv(_C.format("twd_amt")),
    "ratio_lessThan1000_allCashTrans": "avg(CASE WHEN twd_amt > 0 THEN (CASE WHEN twd_amt < 1000 THEN 1 ELSE 0 END) END)",
    "ratio_weirdAmt_allCashTrans": "avg(CASE WHEN twd_amt > 0 THEN (CASE WHEN coalesce(twd_amt % 1000 <> 0, TRUE) "
                                   "THEN 1 ELSE 0 END) END)",
}


@register("conditional_profile", sql=with_ctes(SEQ[:-2], "SELECT label, actor_id, count(DISTINCT event) AS kindsOfEvent, "
          + ", ".join((f"round({e}, 6) AS {n}" if n in COND_DOUBLES else f"{e} AS {n}")
                      for n, e in _COND_SQL.items())
          + " FROM sessioned GROUP BY label, actor_id"))
def q_conditional_profile(spark, sf_dir):
    prof = conditional_profile(sessioned(spark, sf_dir, ["cash_flow"]))
    return prof.select(*[F.round(c, 6).alias(c) if c in COND_DOUBLES else F.col(c) for c in prof.columns])


@register("weekend_share", sql=with_ctes(FEATURES, """
SELECT label, action_time_isWeekend_1, n, isWeekend_percent FROM (
  SELECT label, action_time_isWeekend_1, count(*) AS n,
    CASE WHEN label IN (0, 1, 2) THEN count(*) / sum(count(*)) OVER (PARTITION BY label) ELSE 0.0 END
      AS isWeekend_percent
  FROM features GROUP BY label, action_time_isWeekend_1) s
WHERE isWeekend_percent > 0.001"""))
def q_weekend_share(spark, sf_dir):
    return weekend_share(features(spark, sf_dir))


@register("null_counts", sql=with_ctes(BASE, "UNPIVOT (SELECT "
          + ", ".join(f"count(*) FILTER (WHERE {c} IS NULL) AS {c}" for c in JOINED_COLUMNS)
          + " FROM joined) ON COLUMNS(*) INTO NAME column_name VALUE n_null"))
def q_null_counts(spark, sf_dir):
    return null_counts(joined(spark, sf_dir))
