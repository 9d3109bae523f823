"""Query registry: name -> Spark builder (+ optional equivalent SQL).

Each builder takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the
given tables.  ``sql`` is the same query in plain SQL over the raw tables
(used as an independent oracle); ``None`` marks a query that SQL cannot
express (iterative fits, PCA) and is checked by tests instead.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from txnflow.session import ship_package

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    bench: bool


QUERIES: dict[str, Query] = {}


def register(name: str, sql: str | None = None, bench: bool = False):
    def wrap(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)          # executors import txnflow for pandas UDFs
            return fn(spark, sf_dir)

        QUERIES[name] = Query(name, build, sql, bench)
        return fn
    return wrap
