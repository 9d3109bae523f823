"""Reproduce the hot-key measurements of docs/PLANS.md.

Runs skewed fixtures through the library's operator and through the
plain formulation, with Spark's event log written to a scratch folder, and
prints each row-level stage's largest task share of shuffle-read records.

    python tools/skew_check.py
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from txnflow.operators import sessions  # noqa: E402
from txnflow.operators.journey import join_accounts  # noqa: E402
from txnflow.operators.sampling import exact_rank, keyed_hash  # noqa: E402
from txnflow.operators.sessions import gap_sessions  # noqa: E402
from txnflow.session import build_session  # noqa: E402

N = 300_000


def noop(df):
    df.write.format("noop").mode("overwrite").save()


def run_cases(spark):
    sc = spark.sparkContext
    # Sessions: one actor holds a third of the rows.
    rows = spark.range(N).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
            F.concat(F.lit("a"), (F.col("id") % 1000).cast("string"))).alias("actor_id"),
        (F.lit(1704067200) + F.col("id") * 8).alias("action_epoch"), F.lit("e").alias("event"))
    sc.setJobGroup("sessions:chunked", "")
    noop(gap_sessions(rows))
    sc.setJobGroup("sessions:plain", "")
    w = Window.partitionBy("actor_id").orderBy("action_epoch")
    noop(rows.withColumn("g", F.col("action_epoch") - F.lag("action_epoch").over(w)))

    # Sessions: all rows of the hot actor in one hour; none of them with a time.
    for case, time in (("burst", F.lit(1704067200) + F.col("id") % 3600), ("timeless", F.lit(None).cast("long"))):
        packed = rows.withColumn("id", F.monotonically_increasing_id()) \
            .withColumn("action_epoch", F.when(F.col("actor_id") == "hot", time).otherwise(F.col("action_epoch"))) \
            .withColumn("event", F.col("id").cast("string")).drop("id")
        for most in (2_000, 1 << 40):
            sessions.CHUNK_ROWS = most
            sc.setJobGroup(f"sessions:{case}, " + ("by count" if most < N else "by hour"), "")
            noop(gap_sessions(packed))
    sessions.CHUNK_ROWS = 200_000

    # Split ranking: 90 % of the actors have one label.
    actors = spark.range(N).select(F.col("id").cast("string").alias("actor_id"),
                                   F.when(F.col("id") % 10 < 9, 0).otherwise(1).alias("label"))
    actors = actors.withColumn("_h", keyed_hash(99, "actor_id"))
    sc.setJobGroup("rank:two-phase", "")
    noop(exact_rank(actors, ["label"], "_h", "actor_id"))
    sc.setJobGroup("rank:plain", "")
    noop(actors.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("_h", "actor_id"))))

    # Counterparty join: a third of the rows have no counterparty account.
    journey = spark.range(N).select(
        (F.col("id") % 1000).cast("string").alias("actor_id"), F.lit("e").alias("event"),
        F.lit("202401").alias("behavior_yyyymm"), F.lit("self").alias("action_sponsor"),
        F.col("id").alias("action_time"), F.lit("t").alias("action_type"),
        (F.col("id") % 1000).cast("string").alias("object_id"), F.lit(1.0).alias("twd_amt"),
        F.lit("TWD").alias("txn_currency_code"), F.lit("d").alias("txn_type_desc"), F.lit("l").alias("atm_location"),
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise((F.col("id") % 997).cast("string")).alias("target_acct_nbr"),
        F.lit("013").alias("target_bank_code"))
    accounts = spark.range(1000).select(
        F.col("id").cast("string").alias("customer_id"), F.col("id").cast("string").alias("acct_nbr"),
        F.lit("I").alias("customer_class_code"), F.lit("P").alias("yyyymm"), F.lit("2001").alias("start_ym"),
        F.lit(0).alias("label"))
    sc.setJobGroup("join:spread-nulls", "")
    noop(join_accounts(journey, accounts, "P"))
    sc.setJobGroup("join:plain", "")
    t = accounts.select(F.col("customer_id").alias("target_customer_id"), F.col("acct_nbr").alias("ta"))
    noop(journey.join(t, journey["target_acct_nbr"] == t["ta"], "left"))


def main():
    logdir = tempfile.mkdtemp(prefix="txnflow-skew-")
    spark = build_session(shuffle_partitions=64, conf={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://" + logdir,
        "spark.eventLog.compress": "false",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.skewJoin.enabled": "false",              # measure the plan, not AQE's repair
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"})
    run_cases(spark)
    spark.stop()
    log = [p for p in glob.glob(logdir + "/**/events*", recursive=True) if os.path.isfile(p)][0]
    group_of, records = {}, {}
    for line in open(log):
        e = json.loads(line)
        if e["Event"] == "SparkListenerJobStart":
            for sid in e.get("Stage IDs", []):
                group_of[sid] = e.get("Properties", {}).get("spark.jobGroup.id")
        elif e["Event"] == "SparkListenerTaskEnd":
            m = (e.get("Task Metrics") or {}).get("Shuffle Read Metrics") or {}
            records.setdefault(e["Stage ID"], []).append(m.get("Total Records Read", 0))
    for sid, rs in sorted(records.items()):
        total = sum(rs)
        if total >= 0.3 * N:
            print(f"{group_of.get(sid):22s} stage {sid:3d}  tasks {len(rs):3d}  records {total:8d}  "
                  f"largest task {max(rs) / total:6.1%}")


if __name__ == "__main__":
    main()
