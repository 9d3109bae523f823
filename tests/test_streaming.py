"""The streaming feature job gives the same rows as the batch operators."""

import tempfile

from pyspark.sql import functions as F

from txnflow.domain import TESTDATA_DOMAIN
from txnflow.operators.clean import clean
from txnflow.operators.features import transaction_features
from txnflow.operators.journey import extract_journey, join_accounts
from txnflow.plans.features import features as batch_features
from txnflow.sources import testdata as td
from txnflow.streaming.journey_stream import feature_stream, read_journey_stream, start_parquet_sink

SF = "/root/testdata/sf0.001"
ALL_WEEKS = ("202401", "202405")


def test_stream_matches_batch(spark):
    root = tempfile.mkdtemp(prefix="txnflow-stream-")
    td.journey_event(spark, SF).repartition(3).write.parquet(f"{root}/source")
    stream = read_journey_stream(spark, f"{root}/source", max_files_per_trigger=1)
    feats = feature_stream(stream, td.accounts(spark, SF), td.LABEL_PERIOD, TESTDATA_DOMAIN,
                           td.OBSERVATION_PERIOD, td.JOURNEY_EVENTS, watermark="60 days")
    q = start_parquet_sink(feats, f"{root}/sink", f"{root}/checkpoint")
    q.awaitTermination(300)
    cols = ["actor_id", "action_epoch", "event", "cat_action", "cash_flow", "isCrossBank"]
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/sink").select(*cols).collect())
    want = sorted(tuple(r) for r in batch_features(spark, SF).select(*cols).collect())
    assert got == want and len(got) > 0


def test_stream_drops_late_rows(spark):
    root = tempfile.mkdtemp(prefix="txnflow-late-")
    ev = td.journey_event(spark, SF)
    accounts = td.accounts(spark, SF)

    def run():
        stream = read_journey_stream(spark, f"{root}/source/*")
        feats = feature_stream(stream, accounts, td.LABEL_PERIOD, TESTDATA_DOMAIN, ALL_WEEKS,
                               td.JOURNEY_EVENTS, watermark="1 hour")
        start_parquet_sink(feats, f"{root}/sink", f"{root}/checkpoint").awaitTermination(300)

    # First run: the newest events move the watermark forward (it is kept in the checkpoint).
    ev.orderBy("action_time", ascending=False).limit(50).coalesce(1).write.parquet(f"{root}/source/a")
    run()
    first = spark.read.parquet(f"{root}/sink").count()
    # Second run, same checkpoint: old events that the batch pipeline keeps arrive now, and are late.
    old = (ev.filter(F.col("event").isin(*td.JOURNEY_EVENTS) & (F.col("action_sponsor") == "self"))
             .orderBy("action_time").limit(20))
    kept = transaction_features(clean(join_accounts(extract_journey(old, ALL_WEEKS, td.JOURNEY_EVENTS),
                                                    accounts, td.LABEL_PERIOD), TESTDATA_DOMAIN), TESTDATA_DOMAIN)
    assert kept.count() > 0                      # they would produce feature rows if they were on time
    old.coalesce(1).write.parquet(f"{root}/source/b")
    run()
    sink = spark.read.parquet(f"{root}/sink")
    assert sink.count() == first > 0
    assert sink.agg({"action_epoch": "min"}).first()[0] > ev.agg({"action_time": "min"}).first()[0]


def test_stream_sessions_match_batch(spark):
    from txnflow.operators.sessions import gap_sessions
    from txnflow.streaming.sessions_stream import stream_gap_sessions
    root = tempfile.mkdtemp(prefix="txnflow-sess-")
    td.journey_event(spark, SF).coalesce(1).write.parquet(f"{root}/source")
    feats = feature_stream(read_journey_stream(spark, f"{root}/source"), td.accounts(spark, SF), td.LABEL_PERIOD,
                           TESTDATA_DOMAIN, td.OBSERVATION_PERIOD, td.JOURNEY_EVENTS, watermark="1 hour")
    q = (stream_gap_sessions(feats).writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/sink"))
    q.awaitTermination(300)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{root}/sink").select(
        "actor_id", "action_epoch", "gap_seconds", "clust_index", "time_diff").collect())
    batch = gap_sessions(batch_features(spark, SF))
    rows = extract_journey(td.journey_event(spark, SF), td.OBSERVATION_PERIOD, td.JOURNEY_EVENTS)
    last = rows.agg(F.max("action_time")).first()[0]          # what moves the stream's watermark
    want = sorted(tuple(r) for r in batch.filter(F.col("action_epoch") <= last - 3600).select(
        "actor_id", "action_epoch", "gap_seconds", "clust_index", "time_diff").collect())
    assert len(got) > 0.9 * batch.count()
    assert got == want
