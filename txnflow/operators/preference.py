"""Favourite merchant per customer and weekday.

Plan shape (scale): the focus customers are counted first, from the columns that needs, and the fact rows are
cut down to them before anything else is grouped.  Nothing is materialised and nothing is ranked by a window: a
favourite is a minimum over (descending count, descending spend, name), which every task takes of its own rows
before the shuffle.

Ties: every ranking has explicit tie-breakers (the remaining keys), so the
result is deterministic.  Amounts are summed as DECIMAL(18, 2): equal spend is
equal, not equal-up-to-summation-order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CUSTOMER, DOW, CATEGORY, TOWN, MERCHANT = ("customer_id", "dayofweek", "consumption_category_desc",
                                           "loc_type_town", "merchant_name")


def focus_customers(consumption: DataFrame, weeks: tuple[int, int] = (1, 8), min_count: int = 10) -> DataFrame:
    """A4 + F10: customers with at least ``min_count`` located purchases in ``weeks``."""
    rows = consumption.filter(F.col("week").between(*weeks) & F.col(TOWN).isNotNull())
    counts = rows.groupBy(CUSTOMER).agg(F.count(F.lit(1)).alias("consumpt_cnt"))
    return counts.filter(F.col("consumpt_cnt") >= min_count)


def _spend(df: DataFrame, keys) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_cnt"), F.sum(F.col("txn_amt").cast("decimal(18,2)")).alias("_amt"))


def _favourite(df: DataFrame, keys, names) -> DataFrame:
    """The ``names`` of each key with the largest count, then the largest spend, then the smallest names."""
    order = F.struct((-F.col("_cnt")).alias("c"), F.col("_amt").isNull().alias("u"), (-F.col("_amt")).alias("a"),
                     *[F.struct(F.col(n).isNull().alias("u"), F.col(n).alias("v")).alias(n) for n in names])
    return df.groupBy(*keys).agg(F.min(order).alias("_best")).select(*keys, *[F.col(f"_best.{n}.v").alias(n) for n in names])


def merchant_preference(consumption: DataFrame, focus_weeks: tuple[int, int] = (1, 8),
                        profile_weeks: tuple[int, int] = (0, 8), min_count: int = 10,
                        flag: str = "Y") -> DataFrame:
    """The favourite merchant of each focus customer and weekday.

    W1: the customer's favourite (category, town) of a weekday.  W2 orders merchants within (customer, category) by
    count, spend, town and name; W3 takes the first of a town, so within (customer, category, town) it is the
    merchant first by count, spend and name.
    """
    focus = focus_customers(consumption, focus_weeks, min_count).select(CUSTOMER)
    base = (consumption.filter(F.col(TOWN).isNotNull() & F.col("week").between(*profile_weeks) & (F.col("merchant_flag") == flag))
            .join(focus, CUSTOMER, "left_semi"))
    intent = _favourite(_spend(base, [CUSTOMER, DOW, CATEGORY, TOWN]), [CUSTOMER, DOW], [CATEGORY, TOWN])
    merchant = _favourite(_spend(base, [CUSTOMER, CATEGORY, TOWN, MERCHANT]), [CUSTOMER, CATEGORY, TOWN], [MERCHANT])
    out = intent.join(merchant, [CUSTOMER, CATEGORY, TOWN], "left")
    return out.select(CUSTOMER, CATEGORY, TOWN, DOW, MERCHANT, F.lit(1).alias("train_output_rk"))
