"""Sinks and sources as queries: every table is written by its sink and read again by its source with its declared schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.domain import NON_PCA_FEATURES
from txnflow.operators.sampling import stratified_split
from txnflow.operators.sequences import for_actor, max_timestep
from txnflow.operators.step_blocks import flatten_block, padded_blocks, step_blocks, unflatten_block
from txnflow.plans.extract import joined
from txnflow.plans.features import features
from txnflow.plans.paths import new_path
from txnflow.plans.registry import register
from txnflow.plans.sampling import SPLIT
from txnflow.plans.sequences import ORDER_ASC, ORDER_DESC, SEQ, scaled
from txnflow.plans.sql import BASE, CTE, with_ctes
from txnflow.sources import io

MIDDLE_ACTOR = "SELECT min(actor_id) FROM joined"


@register("csv_roundtrip", sql=with_ctes(BASE, "SELECT * FROM joined"))
def q_csv_roundtrip(spark, sf_dir):
    """The joined rows, sorted across files, as CSV and back; codes stay strings."""
    path = new_path(spark, "transRecord")
    io.write_csv(io.sort_for_output(joined(spark, sf_dir)), path)
    return io.read_csv(spark, path, io.JOINED_SCHEMA)


@register("actor_label_csv", sql=with_ctes(SPLIT[:-1], "SELECT actor_id, label FROM actor_label"))
def q_actor_label_csv(spark, sf_dir):
    """The actor label table as CSV and back."""
    path = new_path(spark, "actorLabelTable")
    io.write_csv(features(spark, sf_dir).select("actor_id", "label").distinct(), path)
    return io.read_csv(spark, path, io.ACTOR_LABEL_SCHEMA)


#: Steps of a block in the queries here; small, so that the test tables' sequences have several.
BLOCK = 16

CTE["seq_rows"] = f"""
SELECT actor_id, label, (SELECT t FROM tmax) - row_number() OVER (PARTITION BY actor_id, label ORDER BY {ORDER_DESC}) AS step,
  [{", ".join(f'round(CAST("{f}" AS DOUBLE), 6)' for f in NON_PCA_FEATURES)}] AS v, clust_index, gap_seconds
FROM scaled
"""


def _rounded(df):
    return df.select([F.round(F.col(f"`{c}`").cast("double"), 6).alias(c) if c in NON_PCA_FEATURES else F.col(f"`{c}`") for c in df.columns])


@register("sequences_json", sql=with_ctes(SEQ + ["seq_rows"], f"""
SELECT actor_id, label, step // {BLOCK} AS block, min(step) AS first_step, list(v ORDER BY step) AS steps FROM seq_rows
WHERE step >= 0 GROUP BY actor_id, label, step // {BLOCK}"""))
def q_sequences_json(spark, sf_dir):
    """Each actor's last steps in blocks, a JSON line each, and back."""
    df = scaled(spark, sf_dir, NON_PCA_FEATURES)
    path = new_path(spark, "make_sequence")
    io.write_json(step_blocks(_rounded(df), NON_PCA_FEATURES, max_timestep(df), BLOCK), path)
    return io.read_json(spark, path, io.BLOCK_SCHEMA)


@register("session_sequences", sql=with_ctes(SEQ + ["seq_rows"], f"""
SELECT actor_id, label, step // {BLOCK} AS block, list(CAST(clust_index AS DOUBLE) ORDER BY step) AS sessions,
  list(CAST(gap_seconds AS DOUBLE) ORDER BY step) AS gaps
FROM seq_rows WHERE step >= 0 GROUP BY actor_id, label, step // {BLOCK}"""))
def q_session_sequences(spark, sf_dir):
    """Q1: blocks of each step's session index and gap, as Parquet and back."""
    df = scaled(spark, sf_dir)
    path = new_path(spark, "session_sequence")
    io.write_parquet(step_blocks(df, ["clust_index", "gap_seconds"], max_timestep(df), BLOCK), path)
    steps = io.read_parquet(spark, path)
    return steps.select("actor_id", "label", "block", F.transform("steps", lambda s: s[0]).alias("sessions"),
                        F.transform("steps", lambda s: s[1]).alias("gaps"))


@register("tensor_blocks", sql=with_ctes(SEQ + ["seq_rows", "actor_label", "split"], f"""
SELECT a.actor_id, a.label, a.split, CAST(s.step // {BLOCK} AS BIGINT) AS block,
  list(coalesce(r.v, list_transform(range({len(NON_PCA_FEATURES)}), lambda i: CAST(0 AS DOUBLE))) ORDER BY s.step) AS steps
FROM split a
CROSS JOIN (SELECT unnest(range(0, (SELECT t FROM tmax))) AS step) s
LEFT JOIN seq_rows r ON r.actor_id = a.actor_id AND r.label = a.label AND r.step = s.step
GROUP BY a.actor_id, a.label, a.split, s.step // {BLOCK}"""))
def q_tensor_blocks(spark, sf_dir):
    """Padded blocks with their split, flattened, written a folder per split, read and unflattened."""
    df = scaled(spark, sf_dir, NON_PCA_FEATURES)
    split = stratified_split(df.select("actor_id", "label").distinct())
    blocks = padded_blocks(_rounded(df), NON_PCA_FEATURES, max_timestep(df), BLOCK).join(split, ["actor_id", "label"])
    path = new_path(spark, "tensors")
    io.write_parquet(blocks.select("actor_id", "label", "split", "block", flatten_block().alias("x")), path, partition_by=("split",))
    back = io.read_parquet(spark, path)
    return back.select("actor_id", "label", F.col("split").cast("string").alias("split"), "block",
                       unflatten_block("x", len(NON_PCA_FEATURES)).alias("steps"))


@register("longest_sequences", sql=with_ctes(SPLIT[:-2], """
SELECT actor_id, label, count(*) AS steps FROM features GROUP BY actor_id, label
ORDER BY steps DESC, actor_id, label LIMIT 20"""))
def q_longest_sequences(spark, sf_dir):
    """The preview of actors by their number of steps."""
    steps = features(spark, sf_dir).groupBy("actor_id", "label").agg(F.count(F.lit(1)).alias("steps"))
    return steps.orderBy(F.desc("steps"), "actor_id", "label").limit(20)


@register("one_actor", sql=with_ctes(BASE, f"SELECT * FROM joined WHERE actor_id = ({MIDDLE_ACTOR})"))
def q_one_actor(spark, sf_dir):
    """the rows of one actor, the first by name, read back from the written table by a point lookup."""
    path = new_path(spark, "joined")
    io.write_parquet(joined(spark, sf_dir), path)
    rows = io.read_parquet(spark, path)
    return for_actor(rows, rows.agg(F.min("actor_id")).first()[0])
