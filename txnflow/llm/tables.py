"""Reading the given tables, and writing intermediate ones to the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from txnflow.session import ensure_checkpoint_dir

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_LISTS: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("lists", default=())


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/txnflow-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The lineage ends there: a lost executor costs a re-read of files.  The write's
    own shuffle files are no longer needed afterwards and are removed at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._txnflow_path = path
    for tables in _LISTS.get():
        tables.append(out)
    return out


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is executed inside are removed when it has ended, not when the driver collects its garbage."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


@contextmanager
def listed() -> Iterator[list[DataFrame]]:
    """A list of the tables that :func:`written` makes inside, also those that are discarded there."""
    tables: list[DataFrame] = []
    token = _LISTS.set((*_LISTS.get(), tables))
    try:
        yield tables
    finally:
        _LISTS.reset(token)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by :func:`written` that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._txnflow_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
