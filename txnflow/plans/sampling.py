"""Entry 2, stage 4 queries: stratified split, under-sampling, class counts, SMOTE."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.operators.sampling import class_counts, stratified_split, undersample
from txnflow.operators.scaling import apply_scaler, fit_scaler
from txnflow.operators.smote import knn_within_class, smote, smote_samples
from txnflow.plans.features import features
from txnflow.plans.registry import register
from txnflow.plans.sql import CTE, FEATURES, with_ctes
from txnflow.session import cut_lineage
from txnflow.sources import testdata as td

K, SMOTE_SEED, UNDER_SEED = 5, 666, 7

CTE["actor_label"] = "SELECT DISTINCT actor_id, label FROM features"
def split_sql(rows: str, key: str) -> str:
    """The stratified split of ``rows`` (key, label)."""
    return f"""
WITH one AS (SELECT {key}, min(label) AS label FROM {rows} GROUP BY {key}),
tn AS (SELECT label, count(*) AS n, (SELECT (count(*) * 3 + 9) // 10 FROM one) AS want, (SELECT count(*) FROM one) AS total
       FROM one GROUP BY label),
tq AS (SELECT label, n * want // total
         + CASE WHEN row_number() OVER (ORDER BY n * want % total DESC, label) <= want - sum(n * want // total) OVER ()
                THEN 1 ELSE 0 END AS quota FROM tn),
t AS (SELECT o.{key}, o.label,
        row_number() OVER (PARTITION BY o.label ORDER BY md5('99|' || CAST(o.{key} AS VARCHAR)), o.{key}) <= q.quota AS is_test
      FROM one o JOIN tq q ON o.label = q.label),
rest AS (SELECT {key}, label FROM t WHERE NOT is_test),
vn AS (SELECT label, count(*) AS n, (SELECT (count(*) + 3) // 4 FROM rest) AS want, (SELECT count(*) FROM rest) AS total
       FROM rest GROUP BY label),
vq AS (SELECT label, n * want // total
         + CASE WHEN row_number() OVER (ORDER BY n * want % total DESC, label) <= want - sum(n * want // total) OVER ()
                THEN 1 ELSE 0 END AS quota FROM vn),
v AS (SELECT r.{key},
        row_number() OVER (PARTITION BY r.label ORDER BY md5('43|' || CAST(r.{key} AS VARCHAR)), r.{key}) <= q.quota AS is_val
      FROM rest r JOIN vq q ON r.label = q.label),
s AS (SELECT {key}, 'test' AS split FROM t WHERE is_test
      UNION ALL SELECT {key}, CASE WHEN is_val THEN 'val' ELSE 'train' END FROM v)
SELECT a.{key}, a.label, s.split FROM {rows} a JOIN s ON a.{key} = s.{key}
"""


CTE["split"] = split_sql("actor_label", "actor_id")
CTE["under"] = f"""
WITH rows AS (SELECT * FROM split WHERE split IN ('train', 'val')),
keep AS (SELECT split, count(*) AS k FROM rows WHERE label = 2 GROUP BY split),
maj AS (SELECT r.*, row_number() OVER (PARTITION BY r.split ORDER BY md5('{UNDER_SEED}|' || r.actor_id), r.actor_id)
          AS rk FROM rows r WHERE label = 0)
SELECT m.actor_id, m.label, m.split FROM maj m LEFT JOIN keep k ON m.split = k.split
WHERE m.rk <= coalesce(k.k, 0)
UNION ALL SELECT actor_id, label, split FROM rows WHERE label <> 0
"""
SPLIT = FEATURES + ["actor_label", "split"]


def split(spark, sf_dir):
    return stratified_split(features(spark, sf_dir).select("actor_id", "label").distinct())


@register("actor_label", sql=with_ctes(SPLIT[:-1], "SELECT actor_id, label FROM actor_label"))
def q_actor_label(spark, sf_dir):
    """A3 + J5: one row per (actor, label) of the feature table (the actor label table)."""
    return features(spark, sf_dir).select("actor_id", "label").distinct()


@register("stratified_split", sql=with_ctes(SPLIT, "SELECT * FROM split"))
def q_stratified_split(spark, sf_dir):
    return split(spark, sf_dir)


@register("undersample", sql=with_ctes(SPLIT + ["under"], "SELECT * FROM under"))
def q_undersample(spark, sf_dir):
    return undersample(split(spark, sf_dir), seed=UNDER_SEED)


@register("split_counts", sql=with_ctes(SPLIT + ["under"], """
SELECT 'split' AS stage, split, label, count(*) AS n FROM split GROUP BY split, label
UNION ALL SELECT 'undersampled', split, label, count(*) FROM under GROUP BY split, label"""))
def q_split_counts(spark, sf_dir):
    s = split(spark, sf_dir)
    a = class_counts(s).withColumn("stage", F.lit("split"))
    b = class_counts(undersample(s, seed=UNDER_SEED)).withColumn("stage", F.lit("undersampled"))
    return a.unionByName(b).select("stage", "split", "label", "n")


@register("scale_fit_on_train", sql=with_ctes(SPLIT, """
, tr AS (SELECT twd_amt FROM features WHERE actor_id IN (SELECT actor_id FROM split WHERE split = 'train'))
SELECT actor_id, action_epoch, event, twd_amt,
  round((twd_amt - (SELECT avg(twd_amt) FROM tr))
        / (SELECT CASE WHEN coalesce(stddev_pop(twd_amt), 0) > 0 THEN stddev_pop(twd_amt) ELSE 1 END FROM tr), 6)
    AS twd_amt_scaled
FROM features""".replace("\n, tr", ",\ntr")))
def q_scale_fit_on_train(spark, sf_dir):
    df = cut_lineage(features(spark, sf_dir).select("actor_id", "label", "action_epoch", "event", "twd_amt"))   # read by split, fit, output
    train = stratified_split(df.select("actor_id", "label").distinct()).filter(F.col("split") == "train")
    train = train.select("actor_id")
    stats = fit_scaler(df.join(train, "actor_id", "left_semi"), "twd_amt")
    out = apply_scaler(df, "twd_amt", "twd_amt_scaled", stats)
    return out.select("actor_id", "action_epoch", "event", "twd_amt",
                      F.round("twd_amt_scaled", 6).alias("twd_amt_scaled"))


CTE["emb"] = "SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS features FROM embeddings"
CTE["plan"] = """
WITH c AS (SELECT label, count(*) AS n FROM emb GROUP BY label)
SELECT label, n, (SELECT max(n) FROM c) - n AS need FROM c WHERE n < (SELECT max(n) FROM c)
"""
CTE["nbrs"] = f"""
SELECT id, label, CAST(nbr_rank AS INTEGER) AS nbr_rank, nbr_id, distance FROM (
  SELECT a.id, a.label, b.id AS nbr_id, list_distance(a.features, b.features) AS distance,
         row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.features, b.features), b.id) AS nbr_rank
  FROM emb a JOIN emb b ON a.label = b.label AND a.id <> b.id
  WHERE a.label IN (SELECT label FROM plan)) s
WHERE nbr_rank <= {K}
"""


def _h(*parts, digits=15):
    return ("('0x' || substr(md5(concat_ws('|', " + ", ".join(parts) + f")), 1, {digits}))::BIGINT")


CTE["synth"] = f"""
WITH s AS (SELECT label, n, unnest(range(need)) AS sample_idx FROM plan),
h AS (SELECT label, sample_idx,
        {_h(f"'{SMOTE_SEED}'", 'CAST(label AS VARCHAR)', 'CAST(sample_idx AS VARCHAR)', "'base'")} % n + 1 AS base_rank,
        CASE WHEN n > 1 THEN {_h(f"'{SMOTE_SEED}'", 'CAST(label AS VARCHAR)', 'CAST(sample_idx AS VARCHAR)', "'nbr'")}
             % least({K}, n - 1) + 1 END AS nbr_rank,
        {_h(f"'{SMOTE_SEED}'", 'CAST(label AS VARCHAR)', 'CAST(sample_idx AS VARCHAR)', "'gap'", digits=13)} / CAST(4503599627370496 AS DOUBLE) AS u
      FROM s),
members AS (SELECT id, label, features,
              row_number() OVER (PARTITION BY label ORDER BY md5('{SMOTE_SEED}|' || CAST(id AS VARCHAR)), id) AS base_rank
            FROM emb WHERE label IN (SELECT label FROM plan))
SELECT h.label, h.sample_idx, m.id AS base_id, nb.nbr_id, h.u,
  CASE WHEN x.features IS NULL THEN m.features
       ELSE list_transform(list_zip(m.features, x.features), lambda p: p[1] + h.u * (p[2] - p[1])) END AS features
FROM h JOIN members m ON h.label = m.label AND h.base_rank = m.base_rank
LEFT JOIN nbrs nb ON nb.id = m.id AND nb.nbr_rank = h.nbr_rank
LEFT JOIN emb x ON x.id = nb.nbr_id
"""


@register("smote_neighbours", sql=with_ctes(["emb", "plan", "nbrs"], """
SELECT id, label, nbr_rank, nbr_id, round(distance, 6) AS distance FROM nbrs"""))
def q_smote_neighbours(spark, sf_dir):
    v = td.vectors(spark, sf_dir)
    counts = v.groupBy("label").count()
    biggest = counts.agg(F.max("count")).first()[0]
    minority = counts.filter(F.col("count") < biggest).select("label")
    nb = knn_within_class(v, K, classes=minority)
    return nb.select("id", "label", "nbr_rank", "nbr_id", F.round("distance", 6).alias("distance"))


@register("smote_resample", bench=True, sql=with_ctes(["emb", "plan", "nbrs", "synth"], """
SELECT label, sample_idx, base_id, nbr_id, u, unnest(range(len(features))) AS dim,
       round(unnest(features), 6) AS value
FROM synth"""))
def q_smote_resample(spark, sf_dir):
    s = smote_samples(td.vectors(spark, sf_dir), K, SMOTE_SEED)
    rows = s.select("label", "sample_idx", "base_id", "nbr_id", "u",
                    F.posexplode("features").alias("dim", "value"))
    return rows.withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.round("value", 6))


@register("smote_all", sql=with_ctes(["emb", "plan", "nbrs", "synth"], """
SELECT id, CAST(label AS INTEGER) AS label, FALSE AS is_synthetic, unnest(range(len(features))) AS dim, round(unnest(features), 6) AS value
FROM emb
UNION ALL
SELECT NULL, CAST(label AS INTEGER), TRUE, unnest(range(len(features))), round(unnest(features), 6) FROM synth"""))
def q_smote_all(spark, sf_dir):
    """The balanced set, originals and synthetic rows."""
    rows = smote(td.vectors(spark, sf_dir), K, SMOTE_SEED).select(
        "id", "label", "is_synthetic", F.posexplode("features").alias("dim", "value"))
    return rows.withColumn("dim", F.col("dim").cast("long")).withColumn("value", F.round("value", 6))
