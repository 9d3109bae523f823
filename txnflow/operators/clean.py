"""Population filters and missing-value fills."""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_population(df: DataFrame, excluded_event: str, sponsor: str | None = "self",
                      customer_class: str = "I", excluded_label: int = 3) -> DataFrame:
    """Drop one event kind and one label; keep one sponsor and one customer class.

    ``!=`` keeps rows whose value is missing (pandas semantics), hence the
    null-safe comparison.
    """
    cond = ~F.col("event").eqNullSafe(excluded_event) & ~F.col("label").eqNullSafe(excluded_label)
    cond = cond & (F.col("customer_class_code") == customer_class)
    if sponsor is not None:
        cond = cond & (F.col("action_sponsor") == sponsor)
    return df.filter(cond)


def fill_missing(df: DataFrame, columns: Iterable[str], value: str = "unknown") -> DataFrame:
    """Missing categories become their own category."""
    return df.fillna(value, subset=list(columns))


def fill_location(df: DataFrame, online_marker: str, atm_event: str, unknown: str = "unknown",
                  column: str = "atm_location") -> DataFrame:
    """A missing location of a non-ATM event is the online marker, else unknown."""
    loc = F.col(column)
    filled = F.when(loc.isNull() & ~F.col("event").eqNullSafe(atm_event), F.lit(online_marker)).otherwise(loc)
    return df.withColumn(column, F.coalesce(filled, F.lit(unknown)))


def clean(joined: DataFrame, domain, sponsor: str | None = "self") -> DataFrame:
    """Filters, then category fills, then the location fill."""
    df = filter_population(joined, domain.excluded_event, sponsor=sponsor)
    df = fill_missing(df, domain.fill_columns, domain.unknown)
    return fill_location(df, domain.online_location, domain.atm_event, domain.unknown)
