"""Session construction and lineage cutting.

Library code never creates a session; tests, ``bench.py`` and
``__spark_entry__.py`` do, through :func:`build_session`.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning (AQE) does three jobs we rely on instead of hand tuning:
# coalescing small shuffle partitions, converting a sort-merge join to a
# broadcast join only when the *measured* side is below the threshold, and
# splitting skewed join partitions (hot account / actor keys).
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def cluster_conf(input_bytes: float, executor_cores: int = 4, executors: int = 1000,
                 target_partition_bytes: int = 256 * 1024 * 1024) -> dict[str, str]:
    """Settings for a cluster run, sized from the input volume.

    * Scan splits of ``target_partition_bytes`` (fewer, larger tasks than the
      128 MB default; Parquet decoding is cheap per byte).
    * Initial shuffle partitions so that each holds about one target size of
      input (shuffles here carry at most the input volume, usually much less
      after partial aggregation), at least 2 waves of all cores; AQE coalesces
      small ones at run time and splits skewed join partitions.
    * Broadcast only below 64 MB measured size; above it, sort-merge join.
    """
    cores = executor_cores * executors
    partitions = max(2 * cores, int(input_bytes // target_partition_bytes))
    return {
        "spark.sql.files.maxPartitionBytes": str(target_partition_bytes),
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(2 * target_partition_bytes),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * 1024 * 1024),
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.session.timeZone": "UTC",
    }


def build_session(master: str = "local[8]", app: str = "txnflow",
                  shuffle_partitions: int = 8, conf: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app)
    settings = dict(DEFAULT_CONF)
    settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``txnflow`` importable in every Python worker (once per application).

    Pandas UDFs and cogroup functions run in executor Python processes, which
    import this package.  The package's ``.py`` files are zipped on the driver
    and distributed with ``SparkContext.addPyFile`` -- the same as passing
    ``--py-files`` to spark-submit.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    target = os.path.join(tempfile.mkdtemp(prefix="txnflow-pkg-"), "txnflow.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(pkg):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder must be set by the deployment (shared storage);
    if it is missing there we fail rather than write to a machine-local folder.
    Only in local mode (tests) is a scratch folder created when it is unset.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):          # local-cluster has executors of its own
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (e.g. on HDFS / object storage)")
        configured = tempfile.mkdtemp(prefix="txnflow-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and continue from there.

    Used before multi-pass work (fits, scalars, then the main plan): the
    upstream plan runs once instead of once per pass, and a lost executor
    re-reads files instead of replaying the whole lineage.  The data is
    written as a Parquet table (not serialized rows), so each later pass reads
    only the columns it uses and the optimizer sees real file sizes.
    """
    return materialize(df, "lineage")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back.

    Cuts the lineage (a lost executor re-reads files instead of recomputing the
    whole upstream plan) while keeping the data columnar and prunable.
    """
    spark = df.sparkSession
    root = ensure_checkpoint_dir(spark)
    path = f"{root.rstrip('/')}/txnflow-{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def clear_materialized(spark: SparkSession) -> int:
    """Delete this application's materialised tables (``txnflow-*`` in its checkpoint folder).

    Call when the DataFrames built on them are no longer needed (e.g. before
    ``spark.stop()``).  Uses the Hadoop FileSystem of the folder, so it works on
    HDFS and object stores as well as local disk.  Returns the number removed.
    """
    sc = spark.sparkContext
    root = sc.getCheckpointDir()
    if not root:
        return 0
    jvm = sc._jvm
    pattern = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/txnflow-*")
    fs = pattern.getFileSystem(sc._jsc.hadoopConfiguration())
    found = fs.globStatus(pattern) or []
    for status in found:
        fs.delete(status.getPath(), True)
    return len(found)
