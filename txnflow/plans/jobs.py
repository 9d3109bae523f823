"""End-to-end batch job: journey events -> feature table -> sequences -> training set.

The original runs five scripts connected by local CSV / JSON / .npy files.
Here one Spark job does the same work; the three hand-off points become
Parquet / CSV / JSON tables written in parallel to ``out_dir`` (shared
storage), and the feature table is materialised once so every later stage
reads it instead of recomputing the extraction (a lost executor then re-reads
files rather than replaying the whole lineage).
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from txnflow.domain import MODEL_FEATURES, TESTDATA_DOMAIN
from txnflow.operators.features import DROPPED_BEFORE_MODEL, model_columns
from txnflow.operators.sampling import stratified_split
from txnflow.operators.sequences import (build_sequences, flatten, last_steps, max_timestep, pad_sequences,
                                         unflatten)
from txnflow.operators.smote import smote
from txnflow.operators.step_blocks import step_blocks
from txnflow.plans.features import features
from txnflow.plans.model import full_features
from txnflow.session import materialize, ship_package
from txnflow.sources import io


def build_training_set(spark: SparkSession, sf_dir: str, out_dir: str, observ: str = "2401",
                       label_period: str = "2402", try_date: str | None = None, version: str | None = None,
                       desc: str | None = None, oversample_splits=("train",),
                       timesteps: int | None = None) -> dict[str, str]:
    """Write the feature table, actor labels, sequences and the (over-sampled) tensors.

    ``timesteps`` fixes the sequence length T; by default it is the longest
    sequence among actors with a non-zero label, as in the original.  The
    sequences are written in blocks of steps; a tensor row, the model's input, is
    one actor's T steps, so give T where a hot actor would set it.  Returns the written paths by kind.
    """
    ship_package(spark)
    name = lambda kind: f"{out_dir.rstrip('/')}/" + io.dataset_name(kind, observ, label_period, try_date,
                                                                    version, desc)
    paths = {}
    columns = set(features(spark, sf_dir).columns) - set(DROPPED_BEFORE_MODEL)
    feats = materialize(full_features(spark, sf_dir, columns, TESTDATA_DOMAIN), "features")

    paths["features"] = name("featureGeneration")
    io.write_csv(model_columns(feats), paths["features"])
    actor_label = feats.select("actor_id", "label").distinct()
    paths["actor_label"] = name("actorLabelTable")
    io.write_csv(actor_label, paths["actor_label"])

    T = timesteps or max_timestep(feats)
    paths["sequences"] = name("make_sequence")
    io.write_json(step_blocks(feats, MODEL_FEATURES, T), paths["sequences"])
    seqs = build_sequences(last_steps(feats, T), MODEL_FEATURES)

    split = stratified_split(actor_label)
    padded = pad_sequences(seqs, T, len(MODEL_FEATURES)).join(split, ["actor_id", "label"])
    # SMOTE needs one key a row: an actor with two labels has two.
    keyed = padded.select(F.concat_ws("|", "actor_id", "label").alias("id"), "label", "split", flatten("x", "features"))
    parts = []
    for s in ("train", "val", "test"):
        rows = keyed.filter(F.col("split") == s)
        if s in oversample_splits:
            rows = smote(rows.select("id", "label", "features")).withColumn("split", F.lit(s))
        else:
            rows = rows.select("id", "label", "features", F.lit(False).alias("is_synthetic"), "split")
        parts.append(rows)
    tensors = parts[0].unionByName(parts[1]).unionByName(parts[2])
    tensors = tensors.select("id", "label", "split", "is_synthetic",
                             unflatten("features", T, len(MODEL_FEATURES), "x"))
    paths["tensors"] = name("OverSamp")
    io.write_parquet(tensors, paths["tensors"], partition_by=("split",))
    return paths
