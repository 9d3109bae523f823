"""M5-M7: standardisation with population standard deviation.

The fit is one global aggregate (mean, population std) returned to the driver
as two numbers -- never a window without partition, which would pull every
row into one task.  A constant column scales by 1 (its values become 0).
``fit_filter`` fits on a subset (e.g. training actors) and applies to all rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ScalerStats:
    mean: float
    std: float


def fit_scalers(df: DataFrame, columns: Sequence[str], fit_filter: Column | None = None) -> dict[str, ScalerStats]:
    """Mean and population std of several columns in one aggregate (one job)."""
    rows = df if fit_filter is None else df.filter(fit_filter)
    aggs = []
    for i, c in enumerate(columns):
        aggs += [F.avg(c).alias(f"m{i}"), F.stddev_pop(c).alias(f"s{i}")]
    r = rows.agg(*aggs).first()
    out = {}
    for i, c in enumerate(columns):
        mean = float(r[f"m{i}"]) if r[f"m{i}"] is not None else 0.0
        std = float(r[f"s{i}"]) if r[f"s{i}"] is not None else 0.0
        out[c] = ScalerStats(mean, std if std > 0 else 1.0)
    return out


def fit_scaler(df: DataFrame, column: str, fit_filter: Column | None = None) -> ScalerStats:
    return fit_scalers(df, [column], fit_filter)[column]


def apply_scaler(df: DataFrame, column: str, out: str, stats: ScalerStats) -> DataFrame:
    return df.withColumn(out, (F.col(column) - F.lit(stats.mean)) / F.lit(stats.std))


def standardize(df: DataFrame, column: str, out: str | None = None,
                fit_filter: Column | None = None) -> DataFrame:
    return apply_scaler(df, column, out or f"{column}_scaled", fit_scaler(df, column, fit_filter))


def standardize_all(df: DataFrame, columns: Sequence[str], fit_filter: Column | None = None) -> DataFrame:
    """Each column -> ``<column>_scaled``, all fitted in a single pass."""
    stats = fit_scalers(df, columns, fit_filter)
    for c in columns:
        df = apply_scaler(df, c, f"{c}_scaled", stats[c])
    return df
