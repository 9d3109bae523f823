"""Gap to the previous transaction and gap-based session index.

Per actor, ordered by time (and explicit tie-breakers): ``gap_seconds`` to the
previous row (0 for the first), ``time_diff`` = gap in days rounded to 4
decimals (numpy's half-even on the scaled double), and ``clust_index`` = number of gaps strictly longer
than ``cut_seconds`` so far (first session is 0).  The comparison uses the
exact integer gap, so a gap of exactly one day stays in the session.

Scale: a plain ``Window.partitionBy(actor)`` puts every row of an actor in one
task, and one actor may own a large share of all rows.  Rows are therefore cut
into chunks -- a parallel prefix scan:

1. a chunk is an actor's rows of an hour; where these are more than
   ``CHUNK_ROWS`` (a burst, or an actor's rows without a time), they are cut
   further by range partitioning over the whole order, whose bounds Spark takes
   from a sample, so that chunks hold about equally many rows;
2. inside each chunk: previous time, breaks, running break count (parallel);
3. one small row per chunk: first/last time and break count; a window over an
   actor's chunks gives the previous chunk's last time and the number of
   sessions opened before the chunk (tiny: one row per chunk);
4. join the carry back on the chunk; the big side is already partitioned
   on those keys by step 2, so only the small side moves.

Rows without a time come first, with no gap and in the first session; rows
without an actor form an actor of their own.

The input is read by two branches (rows and chunk table) that prune different
columns, so Spark cannot always share one scan: pass a materialised input
(``session.cut_lineage``) when it is expensive to compute.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.session import cut_lineage

DEFAULT_TIE_BREAKERS = ("event", "twd_amt", "action_type", "txn_type_desc", "atm_location",
                        "target_acct_nbr", "acct_nbr", "customer_id", "label")
DAY = 86400


def round_half_even(x: F.Column, decimals: int) -> F.Column:
    """numpy's ``round``: scale, round half to even on the double, scale back."""
    scale = float(10 ** decimals)
    return F.rint(x * scale) / scale


def order_columns(df: DataFrame, time: str, tie_breakers: Iterable[str], descending: bool = False):
    cols = [time] + [c for c in tie_breakers if c in df.columns]
    if descending:
        return [F.col(c).desc_nulls_last() for c in cols]
    return [F.col(c).asc_nulls_first() for c in cols]


CHUNK_ROWS = 200_000         # of an actor's hour, beyond which it is cut further
MOST_OVERFULL = 1 << 20      # chunks that can have more than that; the bound on rows grows with larger tables
CHUNK = ("_actor", "_chunk", "_sub")
NO_TIME = -(1 << 62)         # the chunk of rows without a time: before all others


def with_chunk(df: DataFrame, actor: str | Sequence[str], time: str, chunk_seconds: int) -> DataFrame:
    """``df`` with ``_actor`` and ``_chunk``, which are never null, so that no row is lost in the join on them.

    Several columns of ``actor`` together are one.
    """
    names = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000null")) for c in ([actor] if isinstance(actor, str) else actor)]
    return (df.withColumn("_actor", names[0] if len(names) == 1 else F.concat_ws("\u0001", *names))
              .withColumn("_chunk", F.coalesce(F.floor(F.col(time) / chunk_seconds), F.lit(NO_TIME))))


def chunk_rows(df: DataFrame, actor: str | Sequence[str], time: str, chunk_seconds: int, tie_breakers: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """``df`` with the columns ``CHUNK``, and the chunk table: rows, first and last time of each.

    Chunks of an actor in the order of (_chunk, _sub) are its rows in order.  Rows that agree in the whole order
    may be cut anywhere between them.
    """
    base = with_chunk(df, actor, time, chunk_seconds)
    sizes = [F.count(F.lit(1)).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last")]
    chunks = cut_lineage(base.groupBy("_actor", "_chunk").agg(*sizes))
    total, largest = chunks.agg(F.sum("_n"), F.max("_n")).first()
    most = max(CHUNK_ROWS, (total or 0) // MOST_OVERFULL)
    if (largest or 0) <= most:
        return base.withColumn("_sub", F.lit(0)), chunks.withColumn("_sub", F.lit(0))
    over = chunks.where(F.col("_n") > most)
    rows = over.agg(F.sum("_n")).first()[0]
    # At most MOST_OVERFULL rows.  Sent to all tasks, as a join by shuffle would bring each overfull chunk together.
    over = F.broadcast(over.select("_actor", "_chunk"))
    order = [F.col("_actor"), F.col("_chunk"), *order_columns(base, time, tie_breakers), F.rand(17)]
    ranged = base.join(over, ["_actor", "_chunk"], "left_semi").repartitionByRange(-(-rows // most) + 1, *order)
    ranged = cut_lineage(ranged.withColumn("_sub", F.spark_partition_id() + 1))         # written: both branches see one cut
    kept = base.join(over, ["_actor", "_chunk"], "left_anti").withColumn("_sub", F.lit(0))
    small = chunks.join(over, ["_actor", "_chunk"], "left_anti").withColumn("_sub", F.lit(0))
    return kept.unionByName(ranged), small.unionByName(ranged.groupBy(*CHUNK).agg(*sizes))


def gap_sessions(df: DataFrame, actor: str = "actor_id", time: str = "action_epoch",
                 cut_seconds: int = DAY, chunk_seconds: int = 3600,
                 tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS) -> DataFrame:
    t = F.col(time)
    base, chunks = chunk_rows(df, actor, time, chunk_seconds, tie_breakers)
    w = Window.partitionBy(*CHUNK).orderBy(*order_columns(base, time, tie_breakers))
    df = (base.withColumn("_prev", F.lag(time).over(w))
              .withColumn("_brk", F.when(t - F.col("_prev") > cut_seconds, 1).otherwise(0))
              .withColumn("_run", F.sum("_brk").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))

    if chunk_seconds <= cut_seconds:
        # Two rows of one chunk are less than a cut apart, so sessions only break
        # between chunks: the carry needs the chunk table only, taken straight from
        # the input with map-side partial aggregation.
        chunks = chunks.withColumn("_inner", F.lit(0).cast("long"))
    else:
        chunks = df.groupBy(*CHUNK).agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.sum("_brk").alias("_inner"))
    wc = Window.partitionBy("_actor").orderBy("_chunk", "_sub")
    chunks = (chunks.withColumn("_prev_last", F.lag("_last").over(wc))
                    .withColumn("_entry", F.when(F.col("_first") - F.col("_prev_last") > cut_seconds, 1).otherwise(0))
                    .withColumn("_base", F.sum(F.col("_inner") + F.col("_entry"))
                                .over(wc.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_inner"))
                    .select(*CHUNK, "_prev_last", "_base"))

    out = df.join(chunks, [*CHUNK])
    gap = F.coalesce(t - F.coalesce(F.col("_prev"), F.col("_prev_last")), F.lit(0)).cast("long")
    out = (out.withColumn("gap_seconds", gap)
              .withColumn("clust_index", (F.col("_base") + F.col("_run")).cast("int"))
              .withColumn("time_diff", round_half_even(F.col("gap_seconds") / F.lit(float(DAY)), 4)))
    return out.drop(*CHUNK, "_prev", "_brk", "_run", "_prev_last", "_base")


def session_sizes(sessioned: DataFrame, actor: str = "actor_id", time: str = "action_epoch") -> DataFrame:
    """Rows, first and last time per (actor, session)."""
    return sessioned.groupBy(actor, "clust_index").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))
