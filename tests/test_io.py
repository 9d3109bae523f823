"""Sinks round-trip through CSV, JSON and Parquet with declared schemas."""

import tempfile

from pyspark.sql import functions as F

from txnflow.sources import io


def test_round_trips(spark):
    df = spark.createDataFrame([("007", "013", 1), ("8", None, 2)], "actor_id string, bank string, label int")
    root = tempfile.mkdtemp(prefix="txnflow-io-")
    schema = "actor_id string, bank string, label int"
    io.write_csv(df, f"{root}/csv")
    back = io.read_csv(spark, f"{root}/csv", schema)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    seq = spark.createDataFrame([("a", 1, [[0.0, 1.0], [2.0, 3.0]])], io.SEQUENCE_SCHEMA)
    io.write_json(seq, f"{root}/json")
    assert io.read_json(spark, f"{root}/json", io.SEQUENCE_SCHEMA).first().steps == [[0.0, 1.0], [2.0, 3.0]]
    io.write_parquet(seq.withColumn("split", F.lit("train")), f"{root}/pq", partition_by=("split",))
    assert io.read_parquet(spark, f"{root}/pq").first().split == "train"


def test_dataset_name():
    name = io.dataset_name("featureGeneration", "1910_1912", "2001", "20200301", "v1", "smote")
    assert name == "featureGeneration__observ_1910_1912_labeled_2001_20200301_v1_smote"


def test_build_training_set(spark):
    from txnflow.plans.jobs import build_training_set
    out = tempfile.mkdtemp(prefix="txnflow-job-")
    paths = build_training_set(spark, "/root/testdata/sf0.001", out, try_date="20240301", version="v1")
    t = spark.read.parquet(paths["tensors"])
    counts = {(r.split, r.label): r["count"] for r in t.groupBy("split", "label").count().collect()}
    train = [n for (s, _), n in counts.items() if s == "train"]
    assert len(set(train)) == 1                                  # train classes balanced by SMOTE
    x = t.select(F.size("x").alias("T"), F.size(F.col("x")[0]).alias("F")).distinct().collect()
    assert len(x) == 1 and x[0].F == 22
    labels = spark.read.option("header", True).csv(paths["actor_label"])
    assert labels.count() == t.filter(~F.col("is_synthetic")).count()


def test_sort_for_output_orders_files(spark):
    rows = [("a", t) for t in range(50)] + [("b", t) for t in range(5)]
    df = spark.createDataFrame(rows, "actor_id string, action_time long")
    out = io.sort_for_output(df, partitions=4)
    parts = out.rdd.glom().collect()
    flat = [tuple(r) for p in parts for r in p]
    assert flat == sorted(rows)


def test_cluster_conf_scales_with_input():
    from txnflow.session import cluster_conf
    conf = cluster_conf(100 * 1024 ** 4)
    assert int(conf["spark.sql.shuffle.partitions"]) == 100 * 1024 ** 4 // (256 * 1024 ** 2)
    assert int(cluster_conf(1024 ** 3)["spark.sql.shuffle.partitions"]) == 8000   # two waves of 4000 cores


def test_read_table_lexicon_and_actor_lookup(spark):
    from txnflow.operators.scaling import standardize
    from txnflow.operators.sequences import for_actor
    root = tempfile.mkdtemp(prefix="txnflow-io2-")
    with open(f"{root}/lex.txt", "w", encoding="utf-8") as f:
        f.write("台北車站\n\n 7-ELEVEN \n")
    assert io.read_lexicon(spark, f"{root}/lex.txt") == ["7-ELEVEN", "台北車站"]
    df = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "actor_id string, v double")
    df.write.parquet(f"{root}/t")
    t = io.read_table(spark, f"{root}/t")
    assert [r.actor_id for r in for_actor(t, "b").collect()] == ["b"]
    assert sorted(r.v_scaled for r in standardize(t, "v").collect()) == [-1.0, 1.0]


def test_clear_materialized(spark):
    from txnflow.session import clear_materialized, materialize
    df = materialize(spark.range(10), "probe")
    assert df.count() == 10
    assert clear_materialized(spark) >= 1
    assert clear_materialized(spark) == 0
