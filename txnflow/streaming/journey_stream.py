"""Structured Streaming form of the extraction and per-transaction features.

The original is batch-only; this module runs the *same* operators on an
unbounded journey-event source, for tables that arrive continuously:

* ``readStream`` with the declared journey-event schema;
* duplicate rows (the batch ``DISTINCT``) are dropped with
  ``dropDuplicatesWithinWatermark`` on the event time, so dedup state stays
  bounded by the watermark instead of growing forever;
* the account table is static: a stream-static join (inner for the actor's
  account, left outer for the counterparty);
* cleaning, flags, time parts, one-hots, rule categories and cash flow are
  row-local, so they apply batch by batch unchanged.

Aggregates over the whole history (scalers, PCA, sequences, splits) stay
batch jobs over the sink table.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnflow.domain import Domain
from txnflow.functions.json_leaves import json_leaves, with_parsed
from txnflow.operators.clean import clean
from txnflow.operators.features import transaction_features
from txnflow.operators.journey import JOURNEY_COLUMNS, join_accounts
from txnflow.sources.io import JOURNEY_EVENT_SCHEMA


def read_journey_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(JOURNEY_EVENT_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def extract_journey_stream(stream: DataFrame, period: tuple[str, str], events: Iterable[str],
                           watermark: str = "2 days") -> DataFrame:
    rows = with_parsed(stream.filter(F.col("event").isin(*events) & F.col("yyyymm").between(*period))).select(
        "actor_id", "event", F.col("yyyymm").alias("behavior_yyyymm"), "action_sponsor", "action_time",
        "action_type", "object_id", *json_leaves(),
        F.timestamp_seconds("action_time").alias("event_time"))
    return (rows.withWatermark("event_time", watermark)
                .dropDuplicatesWithinWatermark(list(JOURNEY_COLUMNS)))


def feature_stream(stream: DataFrame, accounts: DataFrame, label_period: str, domain: Domain,
                   period: tuple[str, str], events: Iterable[str], tz: str = "UTC",
                   watermark: str = "2 days") -> DataFrame:
    """Rows later than ``watermark`` behind the newest event time are late data and dropped."""
    journey = extract_journey_stream(stream, period, events, watermark)
    joined = join_accounts(journey, accounts, label_period, keep=("event_time",))   # keeps the watermark column
    return transaction_features(clean(joined, domain), domain, tz)


def start_parquet_sink(features: DataFrame, sink: str, checkpoint: str, available_now: bool = True,
                       processing_time: str | None = None) -> StreamingQuery:
    """Append features to a Parquet table; the checkpoint makes restarts exactly-once."""
    writer = (features.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=processing_time)
    return writer.start(sink)
