"""Exact stratified split and class under-sampling.

Both need "the first n members of a class in a random order".  Randomness is a
keyed hash, ``md5(seed|key)`` (hex, so its string order is its numeric order);
the same rows are chosen on every run, partitioning and engine.

``exact_rank`` is ``row_number() over (partition by group order by hash)``
without a window over a whole class (3 labels would mean 3 tasks): rows are
bucketed by the hash prefix, bucket sizes are counted (a table of at most
groups x 16^prefix rows), prefix sums over that small table give each
bucket's offset, and rows are numbered inside (group, bucket) in parallel.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnflow.session import cut_lineage

SPLITS = ("train", "val", "test")


def keyed_hash(seed: int | str, key: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))


def exact_rank(df: DataFrame, group: Sequence[str], order: str, tie: str, out: str = "rank",
               prefix: int = 3) -> DataFrame:
    """Add ``out`` = 1-based rank by (``order``, ``tie``) within ``group``, and ``group_size``."""
    group = list(group)
    df = df.withColumn("_bucket", F.substring(F.col(order), 1, prefix))
    sizes = df.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (sizes.withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
                  .withColumn("group_size", F.sum("_n").over(Window.partitionBy(*group)))
                  .drop("_n"))
    # At most (#groups x 16^prefix) rows: a proven bound, so it is broadcast.
    df = df.join(F.broadcast(sizes), [*group, "_bucket"])
    inner = Window.partitionBy(*group, "_bucket").orderBy(order, tie)
    return df.withColumn(out, F.col("_offset") + F.row_number().over(inner)).drop("_bucket", "_offset")


def _quota(sizes: DataFrame, label: str, num: int, den: int) -> DataFrame:
    """``sizes`` (label, _n) with ``_quota``: ceil(num / den of all rows) shared out over the labels.

    Each label gets the whole part of its proportional share; what is left goes to the largest remainders, of equal
    ones to the smaller label.  Integers only, so there is no 0.3 * 10 = 3.0000000000000004.  One row per label.
    """
    one = Window.partitionBy(F.lit(0))
    big = lambda c: c.cast("decimal(38,0)")
    total = F.expr(f"(sum(_n) over (partition by 0) * {num} + {den - 1}) div {den}")
    out = sizes.withColumn("_total", F.sum("_n").over(one)).withColumn("_wanted", total)
    out = out.withColumn("_share", F.expr("cast(cast(_n as decimal(19,0)) * cast(_wanted as decimal(19,0)) div _total as long)"))
    out = out.withColumn("_rest", big(F.col("_n")) * big(F.col("_wanted")) - big(F.col("_share")) * big(F.col("_total")))
    rank = F.row_number().over(one.orderBy(F.desc("_rest"), label))
    left = F.col("_wanted") - F.sum("_share").over(one)
    return out.withColumn("_quota", F.col("_share") + F.when(rank <= left, 1).otherwise(0)).select(label, "_quota")


def _first_of_each(rows: DataFrame, key: str, label: str, seed: int, num: int, den: int) -> DataFrame:
    """``rows`` (key, label) with ``_taken``: whether the row is within its label's quota in keyed random order."""
    ranked = exact_rank(rows.withColumn("_h", keyed_hash(seed, key)), [label], "_h", key, out="_r")
    quota = _quota(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")), label, num, den)
    # One row per label: a proven bound.
    return ranked.join(F.broadcast(quota), label).select(key, label, (F.col("_r") <= F.col("_quota")).alias("_taken"))


def stratified_split(actors: DataFrame, key: str = "actor_id", label: str = "label",
                     test: tuple[int, int] = (3, 10), val: tuple[int, int] = (1, 4),
                     test_seed: int = 99, val_seed: int = 43) -> DataFrame:
    """ceil(test * all) actors go to test, then ceil(val * rest) to val, both shared out over the labels.

    Defaults reproduce the 30 % test / 25 %-of-the-rest validation split (52.5 / 17.5 / 30) with the original seeds.
    An actor has one split: with several labels it counts under the smallest, and each of its (key, label)
    rows gets that split, so no actor is in two of them.
    """
    rows = cut_lineage(actors.select(key, label).distinct())       # read by both phases and the output
    one = rows.groupBy(key).agg(F.min(label).alias(label))
    a = cut_lineage(_first_of_each(one, key, label, test_seed, *test))
    rest = _first_of_each(a.filter(~F.col("_taken")).select(key, label), key, label, val_seed, *val)
    split = (a.filter("_taken").select(key, F.lit("test").alias("split"))
             .unionByName(rest.select(key, F.when(F.col("_taken"), "val").otherwise("train").alias("split"))))
    return rows.join(split, key).select(key, label, "split")


def undersample(split: DataFrame, key: str = "actor_id", label: str = "label", major: int = 0,
                target: int = 2, splits: Sequence[str] = ("train", "val"), seed: int = 7) -> DataFrame:
    """R2: inside each split, keep ``n(target)`` members of the ``major`` class, all others."""
    rows = cut_lineage(split.filter(F.col("split").isin(*splits)))
    target_n = rows.filter(F.col(label) == target).groupBy("split").agg(F.count(F.lit(1)).alias("_keep"))
    major_rows = rows.filter(F.col(label) == major).withColumn("_h", keyed_hash(seed, key))
    major_rows = exact_rank(major_rows, ["split"], "_h", key, out="_r")
    # One row per split: a proven bound.
    major_rows = major_rows.join(F.broadcast(target_n), "split", "left")
    kept = major_rows.filter(F.col("_r") <= F.coalesce(F.col("_keep"), F.lit(0))).select(key, label, "split")
    return kept.unionByName(rows.filter(F.col(label) != major).select(key, label, "split"))


def class_counts(df: DataFrame, label: str = "label", by: Sequence[str] = ("split",)) -> DataFrame:
    """Members per (split, label)."""
    return df.groupBy(*by, label).agg(F.count(F.lit(1)).alias("n"))
