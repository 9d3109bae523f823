"""Adapters: derive the pipeline's input tables from the given test tables.

The pipeline reads four kinds of input -- a journey-event table with a JSON
``attrs`` column, an account/label table, a consumption table and a table of
labelled vectors.  The synthetic tables under ``/root/testdata`` have other
shapes, so these functions derive the inputs with plain DataFrame expressions
(the same derivations appear as SQL in :mod:`txnflow.plans.sql`).  They are
lazy: nothing is read until an action runs, and every derived table grows with
the scale factor of its source.
"""

from __future__ import annotations

import datetime
import weakref

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Run parameters for the synthetic data.  Its events span one month, so a period here is an ISO week (year and week); the
# observed period leaves weeks out on both sides, and one account in twenty belongs to another label period.
OBSERVATION_PERIOD = ("202402", "202404")
LABEL_PERIOD = "202402"
JOURNEY_EVENTS = ("atm_transaction", "myatm_transaction", "mybank_transaction")


#: Partitions that scans of the large tables are redistributed to; None leaves Spark's splits.  ``bench.py`` sets it, because
#: each of its test files is one unsplittable row group.  A deployment with many files has no use for it.
input_partitions: int | None = None
LARGE = {"events", "lineitem", "orders", "documents"}


# Read plans per session: listing files and reading Parquet footers happens once
# per table and session, not once per query.  Only the lazy plan is kept (no
# data), and the entry dies with its session.
_READS: "weakref.WeakKeyDictionary[SparkSession, dict[str, DataFrame]]" = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    reads = _READS.setdefault(spark, {})
    if path not in reads:
        reads[path] = spark.read.parquet(path)
    return reads[path].repartition(input_partitions) if input_partitions and name in LARGE else reads[path]


def _instant(moment: datetime.datetime) -> Column:
    """A literal without a time zone, as the tables' own times: the same instant whatever the session's zone."""
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz")


def week_start(period: str) -> datetime.datetime:
    """The Monday that an ISO week (year and week) begins with."""
    return datetime.datetime.fromisocalendar(int(period[:4]), int(period[4:]), 1)


def _event_name(event_type: Column) -> Column:
    return (F.when(event_type == "click", "mybank_transaction")
            .when(event_type == "view", "myatm_transaction")
            .when(event_type == "purchase", "atm_transaction")
            .when(event_type == "signup", "browse")
            .otherwise(event_type))


def journey_event(spark: SparkSession, sf_dir: str, period: tuple[str, str] | None = None) -> DataFrame:
    """``events`` (+ ``part`` for wording) -> journey-event rows with JSON attrs.

    ``period`` (first and last ISO week) also bounds ``ts``, which, unlike the derived period, reaches the scan.

    Schema: actor_id, event, yyyymm, action_sponsor, action_time (epoch s),
    action_type, object_id, attrs (JSON string with action/channel/object).
    """
    events = table(spark, sf_dir, "events")
    if period is not None:
        end = week_start(period[1]) + datetime.timedelta(days=7)
        events = events.filter((F.col("ts") >= _instant(week_start(period[0]))) & (F.col("ts") < _instant(end)))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_name", "p_brand")
    ev = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    ev = ev.join(part, ev["k"] == part["p_partkey"], "left")

    k, eid, etype = F.col("k"), F.col("event_id"), F.col("event_type")
    twd_amt = (F.floor("value") * 10).cast("double")
    target_acct = F.when((etype == "click") & (eid % 7 == 0), F.lit(None)).otherwise(k.cast("string"))
    bank = F.when(k < 40, "013").when(k >= 90, F.lit(None)).otherwise("812")
    currency = F.when(k % 10 == 0, "USD").when(k % 10 == 1, F.lit(None)).otherwise("TWD")
    txn_desc = F.when(eid % 13 == 0, F.lit(None)).otherwise(F.col("p_name"))
    location = F.when(etype.isin("purchase", "view") & (k % 4 != 3),
                      F.concat_ws(" ", "p_brand", "p_name"))
    attrs = F.to_json(F.struct(
        F.struct(twd_amt.alias("twd_amt"), currency.alias("txn_currency_code"),
                 txn_desc.alias("txn_type_desc")).alias("action"),
        F.struct(location.alias("atm_location")).alias("channel"),
        F.struct(target_acct.alias("target_acct_nbr"), bank.alias("target_bank_code")).alias("object"),
    ))
    return ev.select(
        F.col("user_id").cast("string").alias("actor_id"),
        _event_name(etype).alias("event"),
        F.format_string("%d%02d", F.extract(F.lit("YEAROFWEEK"), "ts"), F.weekofyear("ts")).alias("yyyymm"),
        F.when(eid % 5 == 0, "others").otherwise("self").alias("action_sponsor"),
        F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("action_time"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("action_type"),
        F.col("user_id").cast("string").alias("object_id"),
        attrs.alias("attrs"),
    )


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` -> account/label rows for the label month.

    Accounts 50..99 belong to customers 0..49, so those customers make
    transfers between their own accounts (``isSelfTrans``).
    """
    key = F.col("c_custkey")
    owner = F.when(key.between(50, 99), key - 50).otherwise(key)
    digit = key % 10
    return table(spark, sf_dir, "customer").select(
        owner.cast("string").alias("customer_id"),
        key.cast("string").alias("acct_nbr"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "C").otherwise("I").alias("customer_class_code"),
        F.when(key % 20 == 13, "202403").otherwise(LABEL_PERIOD).alias("yyyymm"),
        F.format_string("%d%02d", 2010 + key % 10, 1 + key % 12).alias("start_ym"),
        F.when(digit <= 5, 0).when(digit == 6, 1).when(digit <= 8, 2).otherwise(3).cast("int").alias("label"),
    )


FIRST_DAY = datetime.datetime(1995, 1, 1)          # of week 0 of the consumption table


def consumption(spark: SparkSession, sf_dir: str, weeks: tuple[int, int] | None = None) -> DataFrame:
    """lineitem x orders x part x supplier x nation -> consumption rows.

    ``weeks`` (first and last) also bounds the order date, which, unlike the derived week, reaches the scan.
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey",
                                                  "l_extendedprice", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    if weeks is not None:
        since, until = (FIRST_DAY + datetime.timedelta(weeks=w) for w in (weeks[0], weeks[1] + 1))
        orders = orders.filter((F.col("o_orderdate") >= _instant(since)) & (F.col("o_orderdate") < _instant(until)))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    df = (li.join(orders, li["l_orderkey"] == orders["o_orderkey"])
          .join(part, F.col("l_partkey") == part["p_partkey"])
          .join(supp, F.col("l_suppkey") == supp["s_suppkey"])
          .join(nation, F.col("s_nationkey") == nation["n_nationkey"]))
    day = F.to_date("o_orderdate")
    return df.select(
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.floor(F.datediff(day, F.lit(FIRST_DAY.date())) / 7).cast("int").alias("week"),
        F.dayofweek(day).alias("dayofweek"),
        F.col("p_type").alias("consumption_category_desc"),
        F.when(F.col("n_nationkey") == 0, F.lit(None)).otherwise(F.col("n_name")).alias("loc_type_town"),
        F.col("s_name").alias("merchant_name"),
        F.when(F.col("l_linestatus") == "F", "Y").otherwise("N").alias("merchant_flag"),
        F.col("l_extendedprice").alias("txn_amt"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` -> (id, label, features array<double>) for resampling."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.col("label").cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("features"),
    )
