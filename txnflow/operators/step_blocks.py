"""Q1, Q5-Q7: sequences of any length, stored in blocks of steps.

An actor's sequence is rows (actor, keys, block, first_step, steps): block ``b`` holds the steps ``b * block_steps`` up to
``(b + 1) * block_steps`` of the common axis 0 .. T-1, on which every sequence ends at T-1.  No row, and no group that
makes one, holds more than ``block_steps`` steps, however long an actor's history or ``T`` is; the rank that says where a
step stands comes from the chunked prefix scan of the sessions.  Blocks in order, and steps in order inside them, are
the sequence again.

* ``step_blocks``: the steps an actor has (a block without any does not exist);
* ``padded_blocks``: every block of the axis, with zero steps in front, as dense model input;
* ``unpack_blocks``: one row a step again, with its place on the axis.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.operators.sequences import last_steps
from txnflow.operators.sessions import DEFAULT_TIE_BREAKERS

BLOCK_STEPS = 1024


def gather_blocks(rows: DataFrame, by: Sequence[str], block_steps: int = BLOCK_STEPS, step: str = "step", value: str = "value") -> DataFrame:
    """Rows with a place on the axis and a value -> (by, block, first_step, steps); groups of ``block_steps`` rows at most."""
    items = rows.select(*by, F.floor(F.col(step) / block_steps).cast("long").alias("block"),
                        F.struct(F.col(step).cast("long").alias("step"), F.col(value).alias("value")).alias("_item"))
    blocks = items.groupBy(*by, "block").agg(F.sort_array(F.collect_list("_item")).alias("_items"))
    return blocks.select(*by, "block", F.col("_items")[0]["step"].alias("first_step"), F.transform("_items", lambda i: i["value"]).alias("steps"))


def step_blocks(df: DataFrame, features: Sequence[str], T: int, block_steps: int = BLOCK_STEPS, actor: str = "actor_id",
                keys: Sequence[str] = ("label",), time: str = "action_epoch", tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS,
                chunk_seconds: int = 3600) -> DataFrame:
    """The last ``T`` steps of each (actor, keys) in blocks; steps are arrays of ``features`` as doubles, nulls stay null.

    Rows without a time come first; rows without an actor form an actor of their own.  ``T`` of 0 and an empty table give
    no blocks.
    """
    kept = last_steps(df, T, [actor, *keys], time, tie_breakers, chunk_seconds)
    vector = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    return gather_blocks(kept.select(actor, *keys, (F.lit(T) - F.col("rank_from_end")).alias("step"), vector.alias("value")),
                         [actor, *keys], block_steps)


def padded_blocks(df: DataFrame, features: Sequence[str], T: int, block_steps: int = BLOCK_STEPS, actor: str = "actor_id",
                  keys: Sequence[str] = ("label",), time: str = "action_epoch", tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS,
                  chunk_seconds: int = 3600) -> DataFrame:
    """(actor, keys, block, steps) for every block of the axis: ``block_steps`` steps each, the last one what is left.

    A sequence's steps end at T-1, so only its first block that has any needs zero steps, and they stand in front.
    """
    by = [actor, *keys]
    if T <= 0:
        return df.select(*by).limit(0).select("*", F.lit(0).cast("long").alias("block"), F.array().cast("array<array<double>>").alias("steps"))
    blocks = step_blocks(df, features, T, block_steps, actor, keys, time, tie_breakers, chunk_seconds)
    axis = df.select(*by).distinct().select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit((T - 1) // block_steps).cast("long"))).alias("block"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("a.block") == F.col("b.block")]
    length = F.least(F.lit(block_steps), F.lit(T) - F.col("a.block") * block_steps).cast("int")
    found = F.coalesce(F.col("b.steps"), F.array().cast("array<array<double>>"))
    zeros = F.array_repeat(F.array(*[F.lit(0.0)] * len(features)), length - F.size(found))
    return axis.alias("a").join(blocks.alias("b"), same, "left") \
        .select(*[F.col(f"a.{c}").alias(c) for c in by], F.col("a.block").alias("block"), F.concat(zeros, found).alias("steps"))


def unpack_blocks(blocks: DataFrame, by: Sequence[str], block_steps: int = BLOCK_STEPS) -> DataFrame:
    """(by, step, value): blocks of either kind as one row a step; their steps end where the next block begins."""
    first = F.col("first_step") if "first_step" in blocks.columns else F.col("block") * block_steps
    return blocks.select(*by, first.alias("_first"), F.posexplode("steps").alias("_at", "value")) \
        .select(*by, (F.col("_first") + F.col("_at")).alias("step"), "value")


def flatten_block(steps: str = "steps") -> F.Column:
    """Q7: the steps of a block -> one vector."""
    return F.flatten(F.col(steps))


def unflatten_block(vector: str, n_features: int) -> F.Column:
    """Q7: the vector of a block -> its steps."""
    last = (F.size(F.col(vector)) / n_features).cast("int") - 1
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col(vector), i * n_features + 1, n_features))
