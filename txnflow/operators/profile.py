"""Per-actor profiles, conditional aggregates, shares, null counts.

Every profile is a single ``groupBy(...).agg(...)`` pass: the original's
row-filtered group-bys (``df[amt == 0].groupby``) become conditional
aggregates (``avg(when(cond, x))``), which Spark computes with map-side
partial aggregation -- a hot actor is pre-aggregated in every task before the
shuffle.  Ratios use ``try_divide`` (0/0 gives null, not an ANSI error).
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.functions import flags


def _count_if(cond: Column) -> Column:
    return F.count_if(F.coalesce(cond, F.lit(False)))


def distinct_with_null(column: str, approximate: bool = False, rsd: float = 0.01) -> Column:
    """Distinct values of a column, counting a missing value as one more value.

    ``approximate`` uses HyperLogLog++ (one small sketch per group instead of
    an expanded exact distinct), for very large tables where a relative error
    of ``rsd`` is acceptable.
    """
    value = F.struct(F.col(column))
    return F.approx_count_distinct(value, rsd) if approximate else F.count_distinct(value)


def actor_profile(df: DataFrame, actor: str = "actor_id", label: str = "label",
                  approximate_distinct: bool = False, sponsor: str = "self") -> DataFrame:
    """Nine per-actor measures, labels attached, missing measures as 0.

    ``df`` holds the rows of both sponsors.  The sponsor product counts both;
    the other eight measures describe the actor's own (``sponsor``) rows, and
    actors without such rows are left out -- the population of the cleaned
    table.  One pass: conditional aggregates, no filtered copies.
    """
    own = F.col("action_sponsor") == sponsor
    amt = F.when(own, F.col("twd_amt"))
    cross = F.col("isCrossBank")
    sp = F.col("action_sponsor")

    def own_distinct(c: str) -> Column:
        value = F.when(own, F.struct(F.col(c)))   # a missing value still counts (struct is not null)
        return F.approx_count_distinct(value, 0.01) if approximate_distinct else F.count_distinct(value)

    prof = df.groupBy(actor).agg(
        exact_avg(amt).alias("twdAmt_avg"),
        F.try_divide(F.stddev_pop(amt), exact_avg(amt)).alias("twdAmt_cov"),
        (_count_if(sp == "self") * _count_if(sp == "others")).alias("sponsor_multiply"),
        own_distinct("txn_currency_code").alias("currency_uniqueNum"),
        own_distinct("atm_location").alias("atmLocation_uniqueNum"),
        own_distinct("target_acct_nbr").alias("targetAcct_uniqueNum"),
        own_distinct("acct_nbr").alias("acct_uniqueNum"),
        (_count_if(own & (cross == 0)) * _count_if(own & (cross == 1))).alias("isCrossBank_01multiply"),
        F.sum(F.when(own, F.col("isSelfTrans"))).alias("isSelfTrans_sum"),
        _count_if(own).alias("_own_rows"),
        # The actor's labels come out of the same pass (a handful per actor at
        # most); wrapping in a struct keeps a missing label as a value.
        F.collect_set(F.when(own, F.struct(F.col(label).alias("v")))).alias("_labels"),
    ).filter(F.col("_own_rows") > 0)
    keep = [c for c in prof.columns if c not in ("_labels", "_own_rows")]
    prof = prof.select(*keep, F.explode("_labels").alias("_l")).select(*keep, F.col("_l.v").alias(label))
    return prof.fillna(0)


def exact_avg(x: Column, scale: int = 4) -> Column:
    """Mean of values with at most ``scale`` decimals, summed exactly as DECIMAL.

    A double sum depends on the order rows arrive in (partitioning); the
    decimal sum does not, so the mean is the same on every run and cluster.
    """
    total = F.sum(x.cast(f"decimal(38,{scale})")).cast("double")
    return F.try_divide(total, F.count(x).cast("double"))


def _cv_samp(x: Column, mean: Column | None = None) -> Column:
    return F.try_divide(F.stddev_samp(x), exact_avg(x) if mean is None else mean)


def conditional_profile(df: DataFrame, actor: str = "actor_id", label: str = "label") -> DataFrame:
    """Event kinds, gap and amount means / CVs over all, zero and non-zero rows."""
    amt, gap = F.col("twd_amt"), F.col("time_diff")
    zero, cash, positive = amt == 0, amt != 0, amt > 0
    true_amt = flags.signed_amount(F.col("cash_flow"), amt)
    return df.groupBy(label, actor).agg(
        F.count_distinct("event").alias("kindsOfEvent"),
        F.sum(true_amt).alias("true_amt_sum"),
        exact_avg(gap).alias("avg_timeDiff_allTrans"),
        _cv_samp(gap, exact_avg(gap)).alias("cov_timeDiff_allTrans"),
        exact_avg(F.when(zero, gap)).alias("avg_timeDiff_zeroTrans"),
        _cv_samp(F.when(zero, gap), exact_avg(F.when(zero, gap))).alias("cov_timeDiff_zeroTrans"),
        exact_avg(F.when(cash, gap)).alias("avg_timeDiff_cashTrans"),
        _cv_samp(F.when(cash, gap), exact_avg(F.when(cash, gap))).alias("cov_timeDiff_cashTrans"),
        exact_avg(amt).alias("avg_twdAmt_allTrans"),
        _cv_samp(amt).alias("cov_twdAmt_allTrans"),
        exact_avg(F.when(cash, amt)).alias("avg_twdAmt_allCashTrans"),
        _cv_samp(F.when(cash, amt)).alias("cov_twdAmt_allCashTrans"),
        F.avg(F.when(positive, flags.small_amount(amt))).alias("ratio_lessThan1000_allCashTrans"),
        F.avg(F.when(positive, flags.non_round_amount(amt))).alias("ratio_weirdAmt_allCashTrans"),
    )


def weekend_share(df: DataFrame, label: str = "label", flag: str = "action_time_isWeekend_1",
                  labels: Iterable[int] = (0, 1, 2), min_share: float = 0.001) -> DataFrame:
    """Rows per (label, weekend flag) and their share of the label's rows.

    The window runs over the aggregated table (a handful of rows), never over
    transaction rows.
    """
    counts = df.groupBy(label, flag).agg(F.count(F.lit(1)).alias("n"))
    share = F.when(F.col(label).isin(*labels),
                   F.col("n") / F.sum("n").over(Window.partitionBy(label))).otherwise(F.lit(0.0))
    return counts.withColumn("isWeekend_percent", share).filter(F.col("isWeekend_percent") > min_share)


def null_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, as (column_name, n_null), from one pass."""
    wide = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return wide.unpivot([], [f"`{c}`" for c in df.columns], "column_name", "n_null")
