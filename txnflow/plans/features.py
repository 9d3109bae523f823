"""Entry 2, stage 1 queries: cleaning, flags, time parts, one-hots, rules, cash flow."""

from __future__ import annotations


from txnflow.domain import TESTDATA_DOMAIN
from txnflow.operators.clean import clean
from txnflow.operators.features import transaction_features
from txnflow.plans.extract import joined
from txnflow.plans.registry import register
from txnflow.plans.sql import FEATURES, with_ctes

TZ = "UTC"


def cleaned(spark, sf_dir):
    return clean(joined(spark, sf_dir), TESTDATA_DOMAIN)


def features(spark, sf_dir):
    return transaction_features(cleaned(spark, sf_dir), TESTDATA_DOMAIN, TZ)


def _project(cols):
    def build(spark, sf_dir):
        return features(spark, sf_dir).select(*cols)
    sql = with_ctes(FEATURES, "SELECT " + ", ".join(f'"{c}"' for c in cols) + " FROM features")
    return build, sql


KEY = ["actor_id", "action_epoch", "event"]
PROJECTIONS = {
    "txn_flags": KEY + ["target_bank_code", "target_acct_nbr", "target_customer_id", "isCrossBank",
                        "isSelfTrans", "txn_currency_code", "isExchangeDeal"],
    "time_parts": KEY + ["action_time", "action_time_month", "action_time_day", "action_time_hour",
                         "action_time_dayOfWeek", "action_time_isWeekend_1", "action_time_periodOfDay_1",
                         "action_time_periodOfDay_2", "action_time_periodOfDay_3"],
    "onehot_levels": KEY + ["event_atm_transaction", "event_myatm_transaction", "action_time_isWeekend_1",
                            "action_time_periodOfDay_1", "action_time_periodOfDay_2",
                            "action_time_periodOfDay_3", "cash_flow_-1", "cash_flow_1"],
    "classify_rules": KEY + ["atm_location", "cat_location", "all_action_types", "twd_amt", "cat_action"],
    "cash_flow": KEY + ["action_sponsor", "twd_amt", "all_action_types", "cat_action", "cash_flow"],
    "location_tokens": KEY + ["atm_location", "location_doc"],
}

register("clean_missing", sql=with_ctes(FEATURES[:5], "SELECT * FROM cleaned"), bench=True)(cleaned)
for _name, _cols in PROJECTIONS.items():
    _build, _sql = _project(_cols)
    register(_name, sql=_sql)(_build)
