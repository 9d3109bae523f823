"""Chunks cut by count: bursts, rows without a time and ties give what one window over the actor gives."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnflow.operators import sequences, sessions

SCHEMA = "actor_id string, action_epoch long, event string, n int"
DAY = 86400


@pytest.fixture(scope="module")
def burst(spark):
    rng = random.Random(11)
    rows = [("hot", 10_000 + rng.randrange(3000), f"e{rng.randrange(4000)}") for _ in range(600)]          # one hour
    rows += [("hot", 50 * DAY + rng.randrange(2) * 3 * DAY, f"e{i}") for i in range(300)]                    # two seconds
    rows += [("timeless", None, f"e{rng.randrange(500)}") for _ in range(400)]
    rows += [(None, rng.choice([None, 5, 9 * DAY, 9 * DAY + 1]), f"e{rng.randrange(90)}") for _ in range(300)]
    rows += [(f"a{i % 7}", rng.randrange(20 * DAY), f"e{i}") for i in range(200)]
    rows += [("same", 77, "e") for _ in range(150)]                                                       # equal rows
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], SCHEMA).repartition(6).cache()


def whole(df):
    w = Window.partitionBy("actor_id").orderBy(F.col("action_epoch").asc_nulls_first(), F.col("event").asc_nulls_first())
    gap = F.col("action_epoch") - F.lag("action_epoch").over(w)
    df = df.withColumn("g", gap).withColumn("gap", F.coalesce("g", F.lit(0)))
    return df.withColumn("s", F.sum(F.when(F.col("g") > DAY, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


@pytest.mark.parametrize("most,chunk", [(40, 3600), (40, 10 * DAY), (100_000, 3600), (1, 7)])
def test_sessions(spark, burst, monkeypatch, most, chunk):
    monkeypatch.setattr(sessions, "CHUNK_ROWS", most)
    got = sessions.gap_sessions(burst, chunk_seconds=chunk, tie_breakers=("event",))
    key = lambda r: (r[0] or "", r[1] or -1, r[2], r[3], r[4])
    cols = ["actor_id", "action_epoch", "event"]
    # Among rows of one time, which of them carries the gap follows the order; equal rows are alike.
    assert sorted((tuple(r) for r in got.select(*cols, "gap_seconds", "clust_index").collect()), key=key) == \
        sorted((tuple(r) for r in whole(burst).select(*cols, "gap", "s").collect()), key=key)
    assert set(got.columns) == {*burst.columns, "gap_seconds", "clust_index", "time_diff"}


@pytest.mark.parametrize("most,last", [(40, 100), (40, 5000), (100_000, 250), (1, 30)])
def test_last_steps(spark, burst, monkeypatch, most, last):
    monkeypatch.setattr(sessions, "CHUNK_ROWS", most)
    got = sequences.last_steps(burst, last, tie_breakers=("event",))
    w = Window.partitionBy("actor_id").orderBy(F.col("action_epoch").desc_nulls_last(), F.col("event").desc_nulls_last())
    want = burst.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= last)
    cols = ["actor_id", "action_epoch", "event"]
    key = lambda r: (r[0] or "", r[3])
    assert sorted((tuple(r) for r in got.select(*cols, "rank_from_end").collect()), key=key) == \
        sorted((tuple(r) for r in want.select(*cols, "rank").collect()), key=key)


def test_no_chunk_is_overfull(spark, burst, monkeypatch):
    """Chunks of the burst hold about the bound, and a chunk's rows come before the next one's."""
    monkeypatch.setattr(sessions, "CHUNK_ROWS", 50)
    rows, chunks = sessions.chunk_rows(burst, "actor_id", "action_epoch", 3600, ("event",))
    sizes = rows.groupBy(*sessions.CHUNK).count().collect()
    assert max(r["count"] for r in sizes) <= 150 and sum(r["count"] for r in sizes) == burst.count()
    assert {(r._actor, r._chunk, r._sub): r["count"] for r in sizes} == {(r._actor, r._chunk, r._sub): r._n for r in chunks.collect()}
    hot = rows.where("actor_id = 'hot' and _chunk < 10").groupBy("_chunk", "_sub").agg(
        F.min(F.struct("action_epoch", "event")).alias("lo"), F.max(F.struct("action_epoch", "event")).alias("hi")).orderBy("_chunk", "_sub").collect()
    assert len(hot) > 8 and all(a.hi <= b.lo for a, b in zip(hot, hot[1:]))


def test_chunks_of_nothing(spark, burst):
    assert sessions.gap_sessions(burst.limit(0), tie_breakers=("event",)).collect() == []
    assert sequences.last_steps(burst.limit(0), 3).collect() == []
