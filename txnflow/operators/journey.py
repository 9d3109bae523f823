"""Extract journey events and attach accounts.

``extract_journey``: JSON leaves, event and period filters, row DISTINCT.
``join_accounts``: inner join to the account table on the actor's account,
left join to a renamed second use of it for the counterparty's customer id.

Scale notes
* Filters run before the JSON parse and are pushed to the scan; with a table
  partitioned by ``yyyymm`` the period filter prunes partitions.
* The account table is a dimension.  No broadcast is forced: Spark (and AQE at
  run time, from measured sizes) broadcasts it only below the configured
  threshold, and falls back to a sort-merge join beyond it.
* Rows without a counterparty account (cash withdrawals, enquiries) can be a
  large share of all rows; a null join key would send all of them to one
  reducer.  They get a unique, never-matching key instead, which spreads them
  evenly and leaves the left-join result unchanged.  A hot non-null account is
  split by AQE's skew-join handling.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.functions.json_leaves import JOURNEY_LEAVES, json_leaves, with_parsed

JOURNEY_COLUMNS = ("actor_id", "event", "behavior_yyyymm", "action_sponsor", "action_time", "action_type",
                   "object_id", "twd_amt", "txn_currency_code", "txn_type_desc", "atm_location",
                   "target_acct_nbr", "target_bank_code")
ACCOUNT_COLUMNS = ("customer_id", "acct_nbr", "customer_class_code", "yyyymm", "start_ym", "label")
JOINED_COLUMNS = JOURNEY_COLUMNS + ACCOUNT_COLUMNS + ("target_customer_id",)


def extract_journey(journey_event: DataFrame, period: tuple[str, str], events: Iterable[str],
                    leaves=JOURNEY_LEAVES) -> DataFrame:
    """Journey rows of the chosen events and months, JSON leaves as columns, distinct."""
    rows = journey_event.filter(F.col("event").isin(*events) & F.col("yyyymm").between(*period))
    return with_parsed(rows, "attrs", leaves).select(
        "actor_id", "event", F.col("yyyymm").alias("behavior_yyyymm"), "action_sponsor", "action_time",
        "action_type", "object_id", *json_leaves(leaves),
    ).distinct()


def accounts_for_period(accounts: DataFrame, label_period: str) -> DataFrame:
    return accounts.filter(F.col("yyyymm") == label_period).select(*ACCOUNT_COLUMNS).distinct()


def spread_null_key(key: str, *row_identity: str) -> F.Column:
    """The key itself, or for a null key a unique string no real key can equal."""
    salt = F.xxhash64(*row_identity).cast("string")
    return F.coalesce(F.col(key), F.concat(F.lit("\u0000null:"), salt))


def join_accounts(journey: DataFrame, accounts: DataFrame, label_period: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """J1 inner join on the actor's account, J2 left join for the counterparty.

    ``keep`` names extra journey columns to pass through (e.g. a stream's
    watermarked event time).
    """
    acc = accounts_for_period(accounts, label_period)
    rows = journey.join(acc, journey["object_id"] == acc["acct_nbr"], "inner")
    # Second use of the same account rows, not de-duplicated (an account with two
    # owners fans out, as in the original).
    targets = acc.select(F.col("customer_id").alias("target_customer_id"),
                         F.col("acct_nbr").alias("_target_acct"))
    rows = rows.withColumn("_target_key", spread_null_key("target_acct_nbr", "actor_id", "action_time",
                                                          "event", "object_id"))
    rows = rows.join(targets, rows["_target_key"] == targets["_target_acct"], "left")
    return rows.select(*JOINED_COLUMNS, *keep)
