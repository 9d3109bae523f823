"""Per-transaction features: flags, time parts, one-hot levels, rule categories, cash flow.

All row-local expressions: the whole step is one projection inside whole-stage
codegen, no shuffle.  One-hot levels are declared, so the output schema does
not depend on which values occur in the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.domain import Domain
from txnflow.functions import flags, rules, text, time_parts

EVENT_LEVELS = ("atm_transaction", "myatm_transaction")   # mybank_transaction is the dropped level
PERIOD_LEVELS = (1, 2, 3)                                   # period 0 is the dropped level
CASH_FLOW_LEVELS = (-1, 1)                                  # 0 is dropped

# Columns the original feature table drops before writing (text, codes, keys).
DROPPED_BEFORE_MODEL = ("event", "action_sponsor", "action_type", "cat_action", "txn_currency_code",
                        "txn_type_desc", "all_action_types", "atm_location", "cat_location",
                        "target_bank_code", "target_acct_nbr", "acct_nbr", "customer_class_code", "yyyymm",
                        "start_ym", "customer_id", "object_id", "target_customer_id", "behavior_yyyymm",
                        "location_doc", "action_epoch", "cash_flow", "gap_seconds")


def transaction_flags(df: DataFrame, domain: Domain) -> DataFrame:
    """X4, X5, X10."""
    return df.select(
        "*",
        flags.is_cross_bank(F.col("target_bank_code"), domain.home_bank_code).alias("isCrossBank"),
        flags.is_self_transfer(F.col("actor_id"), F.col("target_customer_id"), F.col("acct_nbr"),
                               F.col("target_acct_nbr")).alias("isSelfTrans"),
        flags.is_exchange_deal(F.col("txn_currency_code"), domain.home_currencies).alias("isExchangeDeal"),
    )


def time_features(df: DataFrame, tz: str = "UTC") -> DataFrame:
    """Calendar parts, weekend/period one-hots, time in days."""
    parts = time_parts.time_parts(F.col("action_time"), tz)
    df = df.select("*", *parts)
    period = F.col("action_time_periodOfDay")
    return df.select(
        *[c for c in df.columns if c not in ("action_time", "action_time_periodOfDay", "action_time_isWeekend")],
        F.col("action_time").alias("action_epoch"),
        time_parts.to_days(F.col("action_time")).alias("action_time"),
        F.col("action_time_isWeekend").alias("action_time_isWeekend_1"),
        *flags.one_hot(period, PERIOD_LEVELS, "action_time_periodOfDay"),
    )


def categories(df: DataFrame, domain: Domain) -> DataFrame:
    """Location category, cleaned location document, action text and category."""
    location = text.replace_text(F.col("atm_location"), domain.location_dash, " ")
    action_text = F.concat(F.col("action_type"), F.lit(" "), F.col("txn_type_desc"))
    return df.select(
        "*",
        rules.classify(location, domain.location_rules, domain.location_default).alias("cat_location"),
        text.location_document(F.col("atm_location"), domain.location_dash, domain.lexicon,
                               domain.stop_words, domain.token_strip).alias("location_doc"),
        action_text.alias("all_action_types"),
        rules.classify(action_text, domain.action_rules, domain.action_default,
                       amount=F.col("twd_amt")).alias("cat_action"),
    )


def cash_flow_features(df: DataFrame, domain: Domain) -> DataFrame:
    """Cash-flow sign and its one-hot levels."""
    flow = flags.cash_flow(F.col("action_sponsor"), F.col("twd_amt"), F.col("all_action_types"),
                           F.col("cat_action"), domain)
    df = df.withColumn("cash_flow", flow)
    return df.select("*", *flags.one_hot(F.col("cash_flow"), CASH_FLOW_LEVELS, "cash_flow"))


def transaction_features(cleaned: DataFrame, domain: Domain, tz: str = "UTC") -> DataFrame:
    """Cleaned journey rows -> every row-local feature (PCA and scaling come later)."""
    df = transaction_flags(cleaned, domain)
    df = time_features(df, tz)
    df = df.select("*", *flags.one_hot(F.col("event"), EVENT_LEVELS, "event"))
    df = categories(df, domain)
    return cash_flow_features(df, domain)


def model_columns(df: DataFrame) -> DataFrame:
    """Drop text, codes and keys the model table does not carry."""
    return df.drop(*[c for c in DROPPED_BEFORE_MODEL if c in df.columns])
