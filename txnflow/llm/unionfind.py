"""Connected components of a table of links, by repeated contraction to stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm.tables import discard, written


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over links: each node but the smallest of its component, with that smallest one first."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent.setdefault(top, top) != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for x, y in zip(a.tolist(), b.tolist()):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = [x for x in parent if root(x) != x]
    return np.array([root(x) for x in nodes], np.int64), np.array(nodes, np.int64)


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of each batch, contracted."""
    for batch in batches:
        yield pa.record_batch([pa.array(x, pa.int64()) for x in spanning(batch.column(0).to_numpy(), batch.column(1).to_numpy())],
                              ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("u", "v")
    least = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "star")
    out = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
    return _replaced(out, least, links)


def _small_star(links: DataFrame) -> DataFrame:
    least = written(links.groupBy("b").agg(F.min("a").alias("m")), "star")
    moved = links.join(least, "b").select(F.col("m").alias("x"), F.col("a").alias("y")).where("x < y")
    return _replaced(moved.union(least.select("m", "b")).toDF("a", "b").distinct(), least, links)


def _replaced(links: DataFrame, *old: DataFrame) -> DataFrame:
    new = written(links, "links")
    discard(*old)
    return new


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b: long, a < b) to (node, component): the smallest node that can be reached.

    Nodes without links, and the smallest of each component, do not appear.  Links of a batch are first contracted
    by union-find; then large and small star steps alternate until every component is a star.  Each step is
    a grouping and a join on nodes and is written to the shared folder.
    """
    now = written(links.mapInArrow(forest, "a long, b long").distinct(), "links")
    seen = _state(now)
    while True:
        now = _small_star(_large_star(now))
        state = _state(now)
        if state == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        seen = state
