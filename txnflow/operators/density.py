"""Gaussian kernel density of a value per group on a grid of points.

Bandwidth is Scott's rule, sample std x n^(-1/5); the grid spans the data
range widened by half the range on each side (the usual KDE plot grid).

No rows x grid join, and no shuffle of values: every task adds the kernels of its
batch of values to its groups' grids at once and sends one partial sum for each
(group, grid point) it has seen, so the widest table has at most tasks x groups x
points rows, however many values there are.  The sum is over all values, near and
far.  A group's grid is a handful of numbers, which are sent to the tasks; groups
are checked to be few.

A group has a density only if its values spread: ``kde_groups`` lists every group
and says which are left out and why.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.session import ship_package

SQRT_2PI = math.sqrt(2.0 * math.pi)
MOST_GROUPS = 4096
CHUNK = 4096                   # values whose kernels are computed together


def kde_groups(df: DataFrame, value: str, group: str) -> DataFrame:
    """(group, n, lo, hi, sd, status): status is ``density``, ``no values``, ``one value`` or ``no spread``."""
    stats = df.groupBy(group).agg(F.count(value).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"),
                                  F.stddev_samp(value).alias("sd"))
    status = F.when(F.col("n") == 0, "no values").when(F.col("n") == 1, "one value") \
        .when((F.col("hi") > F.col("lo")) & (F.col("sd") > 0), "density").otherwise("no spread")
    return stats.withColumn("status", status)


def _partial(groups: list, params: list, points: int):
    """(group number, grid_idx, s): the kernels of a task's values, summed."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        known = pa.array(groups)
        for batch in batches:
            number = pc.fill_null(pc.index_in(batch.column(0), value_set=known), -1).to_numpy()
            values = batch.column(1).to_numpy(zero_copy_only=False)
            for g in np.unique(number[number >= 0]).tolist():
                n, lo, step, bw = params[g]
                x = lo + np.arange(points) * step
                mine, times = np.unique(values[number == g], return_counts=True)
                total = sums.setdefault(g, np.zeros(points))
                for s in range(0, len(mine), CHUNK):
                    total += times[s:s + CHUNK] @ np.exp(-0.5 * ((x[None] - mine[s:s + CHUNK, None]) / bw) ** 2)
        for g, total in sums.items():
            yield pa.record_batch([pa.array(np.full(points, g, np.int32)), pa.array(np.arange(points)), pa.array(total)], ["g", "grid_idx", "s"])
    return run


def kde(df: DataFrame, value: str, group: str, points: int = 1000) -> DataFrame:
    """(group, grid_idx, x, density) for every group with a density; null values take no part."""
    ship_package(df.sparkSession)
    stats = kde_groups(df, value, group).where(f"status = 'density' AND {group} IS NOT NULL").limit(MOST_GROUPS + 1).collect()
    if len(stats) > MOST_GROUPS:
        raise ValueError(f"more than {MOST_GROUPS} groups in {group!r}")
    if not stats:
        return df.sparkSession.createDataFrame([], f"{group} {dict(df.dtypes)[group]}, grid_idx long, x double, density double")
    groups, params = [], []
    for r in sorted(stats, key=lambda r: r[group]):
        width = r["hi"] - r["lo"]
        lo, hi = r["lo"] - 0.5 * width, r["hi"] + 0.5 * width
        groups.append(r[group])
        params.append((r["n"], lo, (hi - lo) / (points - 1), r["sd"] * r["n"] ** -0.2))
    values = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v"))
    parts = values.mapInArrow(_partial(groups, params, points), "g int, grid_idx long, s double")
    pick = lambda column: F.element_at(F.array(*[F.lit(v) for v in column]), F.col("g") + 1)
    n, lo, step, bw = (pick([float(p[i]) for p in params]) for i in range(4))
    return parts.groupBy("g", "grid_idx").agg(F.sum("s").alias("s")) \
        .select(pick(groups).alias(group), "grid_idx", (lo + F.col("grid_idx") * step).alias("x"), (F.col("s") / (n * bw * F.lit(SQRT_2PI))).alias("density"))
