"""The queries of this subpackage: name -> builder and equivalent SQL (None where SQL can't express it)."""

from __future__ import annotations

import functools

from pyspark.sql import SparkSession

from txnflow.plans.registry import Query
from txnflow.session import ship_package

QUERIES: dict[str, Query] = {}
ARROW_BATCH = "8m"


def prepare(spark: SparkSession) -> None:
    """Let executors import this package, and bound the batches that they hand to Python.

    Rows here are whole documents.  Spark's own bound of 64 MB a batch costs that much several times a task, in the
    JVM's buffers and in Python.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BATCH)


def register(name: str, sql: str | None = None):
    def wrap(fn):
        @functools.wraps(fn)
        def build(spark, sf_dir):
            prepare(spark)
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, build, sql, False)
        return fn
    return wrap
