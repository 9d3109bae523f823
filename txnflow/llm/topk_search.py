"""Exact top-k search by inner product over norm-sorted blocks.

Vectors become integers, floor(scale * component).  They are processed by descending length: ranges of
length are blocks, and a query can skip a block, and all after it, once its length times the block's largest is
below its k-th best score (Cauchy-Schwarz).  Within a block the same bound works on parts: both sides are
rotated so that the first coordinates hold most of the length (the singular vectors of all vectors), the partial sum over
those is computed for all, and the rest is at most the product of the residual lengths.  Only vectors whose bound
reaches the k-th best score are scored, on integers, so scores and ties are exact.

Queries form blocks too.  First every query block meets the longest vectors, which gives each query a threshold;
then each meets the blocks that its thresholds leave.  A pair of blocks is one task of bounded size and returns k rows a
query.  To the driver come the rotation's source (dimension squared sums) and the ranges' bounds (at most
``RANGES``), whatever the number of rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from txnflow.llm.tables import written

BLOCK = 4096                   # vectors of a block
QUERIES = 1024                 # queries of a block
RANGES = 1000                  # ranges of length; beyond RANGES * BLOCK vectors a range is split by a hash
CHUNK = 1024                   # vectors between two looks at the thresholds
LAST = (1 << 63) - 1           # stands for a null id
EXACT = float(1 << 53)         # integers up to here are exact as doubles
_FOUND = "query_id long, query_key long, vec_id long, score long"


def _finite(x: Column) -> Column:
    return x.isNotNull() & (x > float("-inf")) & (x < float("inf"))


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, ints, norm) of the vectors that take part."""
    ints = F.transform(vec_col, lambda x: F.floor(x.cast("double") * scale).cast("long"))
    norm = F.sqrt(F.aggregate("ints", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return (vectors.where(F.col(vec_col).isNotNull()).where(F.coalesce(F.forall(vec_col, _finite), F.lit(False)))
            .select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("vec_id"), ints.alias("ints")).withColumn("norm", norm))


def _matrix(column: pa.ChunkedArray, dims: int) -> np.ndarray:
    """Rows of integers, filled up with zeros to ``dims``."""
    lists = column.combine_chunks()
    size = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), dims), np.int64)
    out[np.arange(dims) < size[:, None]] = lists.flatten().to_numpy()
    return out


def _products(dims: int):
    """The summed outer products of a task's vectors, one row a cell."""
    def run(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            x = _matrix(pa.chunked_array([batch.column(0)]), dims).astype(np.float64)
            total += x.T @ x
        cells = np.flatnonzero(total)
        yield pa.record_batch([cells, total.ravel()[cells]], ["cell", "value"])
    return run


def rotation(vectors: DataFrame, dims: int) -> np.ndarray:
    """Singular vectors of all rows as columns, the largest singular value first."""
    cells = vectors.select("ints").mapInArrow(_products(dims), "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    gram = np.zeros(dims * dims)
    for r in cells.collect():                       # dims * dims numbers
        gram[r["cell"]] = r["value"]
    if not np.isfinite(gram).all():
        return np.eye(dims)
    return np.linalg.eigh(gram.reshape(dims, dims))[1][:, ::-1].copy()


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; beyond 64 bits the nearest that a long can hold."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(query).max(initial=0)) * max(1, len(query))
    if bound < EXACT:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if bound < 2.0 ** 62:
        return rows @ query
    return np.array([max(-LAST - 1, min(LAST, s)) for s in rows.astype(object) @ query.astype(object)], np.int64)


def _block_search(k: int, dims: int, turn: Broadcast):
    """Queries (query_id, query_key, ints, least) and vectors (vec_id, ints, norm) of one pair of blocks to the k best of each."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        names = ["query_id", "query_key", "vec_id", "score"]
        if not queries.num_rows or not vectors.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        axes = turn.value
        head = max(1, dims // 4)
        ids = vectors["vec_id"].to_numpy()
        x, norm = _matrix(vectors["ints"], dims), vectors["norm"].to_numpy()
        by = np.lexsort((ids, -norm))
        ids, x, norm = ids[by], x[by], norm[by]
        q, own = _matrix(queries["ints"], dims), queries["query_id"].to_numpy()
        xr, qr = x.astype(np.float64) @ axes, q.astype(np.float64) @ axes
        x_rest, q_rest = np.sqrt((xr[:, head:] ** 2).sum(axis=1)), np.sqrt((qr[:, head:] ** 2).sum(axis=1))
        q_norm = np.sqrt((qr ** 2).sum(axis=1))
        slack = 1e-9 * dims                         # of both lengths: far above the rounding of the rotated sums
        least = queries["least"].to_numpy().astype(np.float64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(ids[:0], ids[:0])] * len(q)
        for lo in range(0, len(ids), CHUNK):
            part = slice(lo, lo + CHUNK)
            some = np.flatnonzero(q_norm * norm[lo] * (1 + slack) >= least)          # the longest vector left
            if not len(some):
                break
            bound = qr[some, :head] @ xr[part, :head].T + np.outer(q_rest[some], x_rest[part]) \
                + slack * np.outer(q_norm[some], norm[part])
            near = bound >= least[some, None]
            for row, i in enumerate(some.tolist()):
                at = lo + np.flatnonzero(near[row])
                at = at[ids[at] != own[i]]
                if not len(at):
                    continue
                found, score = np.concatenate([best[i][0], ids[at]]), np.concatenate([best[i][1], _exact(x[at], q[i])])
                order = np.lexsort((found, -score.astype(np.float64) if np.abs(score).max() < EXACT else [-int(s) for s in score]))[:k]
                best[i] = found[order], score[order]
                if len(order) == k:
                    least[i] = max(least[i], float(score[order[-1]]))
        n = [len(b[0]) for b in best]
        return pa.table([pa.array(np.repeat(own, n)), pa.array(np.repeat(queries["query_key"].to_numpy(), n)),
                         pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=names)
    return run


def search(vectors: DataFrame, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 10,
           scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where ``queries`` holds, the k best among all rows but its own.

    Score: the integer inner product of floor(scale * component); ties go to the smaller id, a null id is
    the largest.  A vector that is null or holds a null or non-finite component takes no part; a shorter one
    counts as filled up with zeros.  Fewer than k candidates: all.  Rows that share a query's id are its own.  A repeated row is a
    candidate each time; a repeated query is answered once, and two vectors of one query id are two queries.
    An empty table, or one without queries, gives no rows.
    """
    spark = vectors.sparkSession
    asked = vectors.where(F.coalesce(queries, F.lit(False)))
    rows = written(scaled(vectors, id_col, vec_col, scale), "vectors")
    number, dims = rows.agg(F.count("*"), F.max(F.size("ints"))).first()
    dims = max(1, dims or 0)
    turn = spark.sparkContext.broadcast(rotation(rows, dims))
    ranges = min(RANGES, math.ceil(number / BLOCK)) or 1
    cuts = rows.agg(F.percentile_approx("norm", [i / ranges for i in range(1, ranges)] or [0.5], 10 * RANGES)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True) if ranges > 1 else []
    block = F.lit(0)
    if cuts:                                        # the number of cuts above the norm: 0 has the longest
        block = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c > F.col("norm")))
    placed = rows.withColumn("block", block)
    sizes = {r["block"]: (r["count"], r["longest"]) for r in
             placed.groupBy("block").agg(F.count("*").alias("count"), F.max("norm").alias("longest")).collect()}   # at most RANGES
    parts = {b: math.ceil(n / BLOCK) for b, (n, _) in sizes.items()}
    split = F.element_at(F.create_map(*[F.lit(v) for b in sorted(parts) for v in (b, parts[b])]), F.col("block")) if parts else F.lit(1)
    placed = placed.withColumn("part", F.pmod(F.xxhash64("vec_id", "ints"), split))

    wanted = scaled(asked, id_col, vec_col, scale).withColumn("query_key", F.xxhash64("ints")) \
        .select(F.col("vec_id").alias("query_id"), "query_key", "ints", "norm").dropDuplicates(["query_id", "query_key"])
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    wanted = written(wanted.withColumn("query_block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(blocks))), "queries")
    keys = ["query_block", "block", "part"]

    def meet(queries_: DataFrame, vectors_: DataFrame, name: str) -> DataFrame:
        """Pairs of blocks: ``queries_`` has a row for each block that a query visits."""
        left = queries_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), split.cast("long") - 1)))
        visits = left.select(*[F.col(c).alias(c) for c in keys]).distinct()
        right = vectors_.join(visits, ["block", "part"]).select("vec_id", "ints", "norm", *[F.col(c).alias(c) for c in keys])
        found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_block_search(k, dims, turn), _FOUND)
        return written(found, name)

    first = min(sizes, default=0)
    none = F.lit(float("-inf"))
    heads = meet(wanted.withColumn("block", F.lit(first)).withColumn("least", none), placed.where(F.col("block") == first), "heads")
    per_query = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    heads_best = heads.withColumn("rank", F.row_number().over(per_query))
    least = heads_best.where(F.col("rank") == k).select("query_id", "query_key", F.col("score").cast("double").alias("least"))
    others = [b for b in sorted(sizes) if b != first]
    found = heads
    if others:
        longest = F.array(*[F.struct(F.lit(b).alias("block"), F.lit(sizes[b][1]).alias("longest")) for b in others])
        left = (wanted.join(least, ["query_id", "query_key"], "left").withColumn("least", F.coalesce("least", none))
                .withColumn("block", F.explode(F.transform(F.filter(
                    longest, lambda b: F.col("norm") * b["longest"] * 1.000001 >= F.col("least")), lambda b: b["block"]))))
        found = heads.union(meet(left, placed.where(F.col("block") != first), "rest"))
    back = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return (found.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= k)
            .select(back("query_id"), F.col("rank").cast("int").alias("rank"), back("vec_id"), "score"))
