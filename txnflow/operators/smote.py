"""SMOTE over-sampling with exact same-class nearest neighbours.

Neighbours come from :mod:`txnflow.operators.knn`: exact, and without
materialising all pairs of a class.  Only classes that are over-sampled (smaller
than the largest) are searched.

Synthesis (``smote``) -- every smaller class is raised to the largest class's
size.  Sample j of class c uses a base member drawn by keyed hash, one of its
k nearest neighbours drawn the same way, and a gap u in [0, 1):
``new = base + u * (neighbour - base)``.  Sample ids come from
``spark.range`` (spread over all tasks), not from exploding one row per
class; the per-class offsets are a handful of numbers held as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnflow.operators.knn import class_sizes, knn_within_class
from txnflow.operators.sampling import exact_rank, keyed_hash
from txnflow.session import cut_lineage


def hash_draw(*parts: Column, digits: int = 15) -> Column:
    """Integer below 16^digits from the first hex digits of md5 over the parts (15 digits: 60 bits)."""
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


GAP_DIGITS = 13             # 52 bits, all of which a double in [0, 1) holds


def smote_plan(df: DataFrame, label: str = "label") -> list[tuple[int, int, int, int]]:
    """[(class, members, needed, first sample id)] for classes below the largest."""
    counts = sorted(class_sizes(df, label).items())
    if not counts:
        return []
    biggest = max(n for _, n in counts)
    plan, start = [], 0
    for c, n in counts:
        if n < biggest:
            plan.append((c, n, biggest - n, start))
            start += biggest - n
    return plan


def smote_samples(df: DataFrame, k: int = 5, seed: int = 666, key: str = "id", label: str = "label",
                  features: str = "features", block_size: int = 16_384) -> DataFrame:
    """Synthetic rows: (label, sample_idx, base_id, nbr_id, u, features)."""
    spark = df.sparkSession
    rows = cut_lineage(df.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"),
                                 F.col(features).alias("features")))
    plan = smote_plan(rows, "label")
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"label int, sample_idx long, base_id {kind}, nbr_id {kind}, u double, features array<double>"
    if not plan:
        return spark.createDataFrame([], schema)
    total = sum(p[2] for p in plan)
    ids = spark.range(total)
    cls, members, first = None, None, None
    for c, n, _, start in plan:
        cond = F.col("id") >= F.lit(start)
        cls = F.when(cond, F.lit(c)) if cls is None else F.when(cond, F.lit(c)).otherwise(cls)
        members = F.when(cond, F.lit(n)) if members is None else F.when(cond, F.lit(n)).otherwise(members)
        first = F.when(cond, F.lit(start)) if first is None else F.when(cond, F.lit(start)).otherwise(first)
    samples = ids.select(cls.cast("int").alias("label"), (F.col("id") - first).alias("sample_idx"),
                         members.cast("long").alias("_members"))
    j, c = F.col("sample_idx"), F.col("label")
    samples = samples.select(
        "label", "sample_idx",
        (F.pmod(hash_draw(F.lit(seed), c, j, F.lit("base")), F.col("_members")) + 1).alias("_base_rank"),
        F.when(F.col("_members") > 1,
               F.pmod(hash_draw(F.lit(seed), c, j, F.lit("nbr")), F.least(F.lit(k), F.col("_members") - 1))
               + 1).alias("_nbr_rank"),
        (hash_draw(F.lit(seed), c, j, F.lit("gap"), digits=GAP_DIGITS) / F.lit(float(16 ** GAP_DIGITS))).alias("u"),
    )
    small = spark.createDataFrame([(p[0],) for p in plan], "label int")
    # ``small`` has one row per over-sampled class: a proven bound.
    members_ranked = exact_rank(rows.join(F.broadcast(small), "label", "left_semi")
                                .withColumn("_h", keyed_hash(seed, "id")), ["label"], "_h", "id", out="_base_rank")
    base = members_ranked.select("label", "_base_rank", F.col("id").alias("base_id"),
                                 F.col("features").alias("_bx"))
    nbrs = knn_within_class(rows, k, block_size, classes=small, materialize=False, sizes={p[0]: p[1] for p in plan}).select(
        F.col("id").alias("base_id"), F.col("nbr_rank").alias("_nbr_rank"), "nbr_id")
    nbr_x = rows.select(F.col("id").alias("nbr_id"), F.col("features").alias("_nx"))
    out = (samples.join(base, ["label", "_base_rank"])
                  .join(nbrs, ["base_id", "_nbr_rank"], "left")
                  .join(nbr_x, "nbr_id", "left"))
    u = F.col("u")
    synth = F.when(F.col("_nx").isNull(), F.col("_bx")).otherwise(
        F.zip_with("_bx", "_nx", lambda b, n: b + u * (n - b)))
    return out.select("label", "sample_idx", "base_id", "nbr_id", "u", synth.alias("features"))


def smote(df: DataFrame, k: int = 5, seed: int = 666, key: str = "id", label: str = "label",
          features: str = "features") -> DataFrame:
    """Originals plus synthetic rows, with ``is_synthetic``."""
    originals = df.select(F.col(key).alias("id"), F.col(label).cast("int").alias("label"),
                          F.col(features).alias("features"), F.lit(False).alias("is_synthetic"))
    synth = smote_samples(df, k, seed, key, label, features).select(
        F.lit(None).cast(df.schema[key].dataType).alias("id"), "label", "features", F.lit(True).alias("is_synthetic"))
    return originals.unionByName(synth)
