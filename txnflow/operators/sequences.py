"""Per-actor step counts, trailing-window sequences, padding.

* ``steps_per_actor`` / ``max_timestep``: rows per (actor, label) and the
  longest sequence among actors with a non-zero label (one scalar).
* ``last_steps``: keep each actor's last ``n`` rows *before* any collect, so an
  array never holds more than ``n`` steps however many rows an actor has.  The
  rank from the end uses the same prefix scan over chunks of rows as the
  sessions, so a hot actor, or a burst of one, is ranked by many tasks.
* ``build_sequences``: one row per actor with its steps as a time-ordered
  ``array<array<double>>`` (time-major, T x F), for a ``T`` that bounds them;
  :mod:`txnflow.operators.step_blocks` has the form for any length.
* ``pad_sequences``: pre-pad with zero steps to ``T`` (or keep the last ``T``).
* ``flatten`` / ``unflatten``: T x F <-> one vector of T*F values.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.operators.sessions import CHUNK, DEFAULT_TIE_BREAKERS, chunk_rows, order_columns


def steps_per_actor(df: DataFrame, actor: str = "actor_id", label: str = "label") -> DataFrame:
    return df.groupBy(actor, label).agg(F.count(F.lit(1)).alias("steps"))


def max_timestep(df: DataFrame, actor: str = "actor_id", label: str = "label") -> int:
    r = steps_per_actor(df, actor, label).filter(F.col(label) != 0).agg(F.max("steps")).first()
    return int(r[0] or 0)


def last_steps(df: DataFrame, n: int, actor: str | Sequence[str] = "actor_id", time: str = "action_epoch",
               tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS, chunk_seconds: int = 3600) -> DataFrame:
    """Rows among the last ``n`` of their actor (one column or several), with ``rank_from_end`` (1 = latest)."""
    base, chunks = chunk_rows(df, actor, time, chunk_seconds, tie_breakers)
    w = Window.partitionBy(*CHUNK).orderBy(*order_columns(base, time, tie_breakers, descending=True))
    df = base.withColumn("_rn", F.row_number().over(w))
    later = Window.partitionBy("_actor").orderBy(F.col("_chunk").desc(), F.col("_sub").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = chunks.select(*CHUNK, F.coalesce(F.sum("_n").over(later), F.lit(0)).alias("_later"))
    out = df.join(counts, [*CHUNK]).withColumn("rank_from_end", F.col("_later") + F.col("_rn"))
    return out.filter(F.col("rank_from_end") <= n).drop(*CHUNK, "_rn", "_later")


def for_actor(df: DataFrame, actor_id: str, actor: str = "actor_id") -> DataFrame:
    """one actor's rows (a point lookup; pushed to the scan when reading a table)."""
    return df.filter(F.col(actor) == actor_id)


def build_sequences(df: DataFrame, features: Sequence[str], actor: str = "actor_id",
                    keys: Sequence[str] = ("label",), time: str = "action_epoch",
                    tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS) -> DataFrame:
    """One row per actor: ``steps`` = time-ordered array of feature arrays."""
    ties = [c for c in tie_breakers if c in df.columns]
    vec = F.array(*[F.col(f"`{f}`").cast("double") for f in features])
    item = F.struct(F.col(time).alias("_t"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(ties)],
                    vec.alias("_v"))
    grouped = df.groupBy(actor, *keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return grouped.select(actor, *keys, F.transform("_items", lambda s: s["_v"]).alias("steps"))


def pad_sequences(seqs: DataFrame, T: int, n_features: int, steps: str = "steps", out: str = "x") -> DataFrame:
    """Q5: zero steps in front up to ``T``; longer sequences keep their last ``T``."""
    zero = F.array_repeat(F.array(*[F.lit(0.0)] * n_features), T)
    padded = F.slice(F.concat(zero, F.col(steps)), -T, T) if T > 0 else F.array()
    return seqs.withColumn(out, padded).drop(steps) if out != steps else seqs.withColumn(out, padded)


def pad_long(df: DataFrame, T: int, features: Sequence[str], actor: str = "actor_id",
             keys: Sequence[str] = ("label",), time: str = "action_epoch",
             tie_breakers: Iterable[str] = DEFAULT_TIE_BREAKERS, chunk_seconds: int = 3600) -> DataFrame:
    """Q5 in long form: (actor, keys, step 0..T-1, features), zero rows in front.

    Same values as ``pad_sequences`` + ``posexplode``, but no per-actor array
    is ever assembled: a row's step is ``T - rank_from_end`` (from the chunked
    ranking) and each actor's ``T - n`` padding rows are generated from its
    one count row.  Nothing is grouped into a single task, however long an
    actor's history (or ``T``) is.
    """
    kept = last_steps(df, T, actor, time, tie_breakers, chunk_seconds)
    values = [F.col(f"`{f}`").cast("double").alias(f) for f in features]
    real = kept.select(actor, *keys, (F.lit(T) - F.col("rank_from_end")).cast("int").alias("step"), *values)
    counts = kept.groupBy(actor, *keys).agg(F.count(F.lit(1)).alias("_n"))
    missing = F.lit(T) - F.col("_n")
    steps = F.when(missing > 0, F.sequence(F.lit(0), (missing - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    pads = counts.select(actor, *keys, F.explode(steps).alias("step"), *[F.lit(0.0).alias(f) for f in features])
    return real.unionByName(pads)


def flatten(x: str = "x", out: str = "features") -> F.Column:
    """Q7: T x F -> T*F."""
    return F.flatten(F.col(x)).alias(out)


def unflatten(v: str, T: int, n_features: int, out: str = "x") -> F.Column:
    """Q7: T*F -> T x F."""
    return F.transform(F.sequence(F.lit(0), F.lit(T - 1)),
                       lambda i: F.slice(F.col(v), i * n_features + 1, n_features)).alias(out)
