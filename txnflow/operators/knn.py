"""Exact k nearest neighbours of the same class, pruned by the triangle inequality.

A class of at most a block is one task.  A larger one is searched in two rounds:

1. A few rows, drawn by keyed hash, are pivots.  Every row belongs to its nearest pivot's cell, and a cell is cut into shells
   of about ``block_size`` rows by the distance to the pivot: these are the blocks.  A row's k-th nearest distance inside its
   own block bounds how far it has to look; where the block has fewer than k others, the pivots' distances and the
   shells' farthest rows give a bound.
2. A row visits only the blocks that may hold something as near: its distance to the cell's pivot must be
   within the bound of the shell's annulus, and the cell's side of the bisecting plane within the bound of the row.
   A block and the rows that visit it meet in tasks of a bounded volume.

Rows are copied once for each block they visit.  With vectors that form clusters these are few; where nothing can be ruled
out (independent high-dimensional noise) they are the number of blocks, half of what comparing all pairs of blocks costs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnflow.operators.sampling import keyed_hash
from txnflow.session import cut_lineage, ship_package

EPS = float(np.finfo(np.float64).eps)
BUDGET = 1_000_000             # float64 elements of a temporary array (8 MB); a search holds about ten
BLOCK_BYTES = 16 << 20         # of a block's vectors; a task holds two blocks and a few copies of them
SMALL = 512                    # rows that a block holds whatever their dimensions
MOST_BLOCKS = 1 << 16          # blocks get larger beyond: their list is sent to every task
MOST_PIVOTS = 256              # of a class
MOST_CLASSES = 4096
RINGS = 1024                   # steps of distance that shells are made of
SLACK = 1e-9                   # relative, of bounds, for rounding


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64, copy=False)


def nearest(qid: np.ndarray, qx: np.ndarray, rid: np.ndarray, rx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, reference, distance) of the k nearest references of every query, by distance, then reference; never its own.

    Squared distances come from one matrix product, ``|q|^2 + |r|^2 - 2 q.r``.  Its rounding error is bounded by
    ``(4D + 16) eps (|q|^2 + |r|^2)``, so a reference whose lower bound exceeds the k-th smallest upper bound cannot be among
    the k nearest.  Only the others (usually about k) are computed again from explicit differences, and the final order
    uses those distances: the result is that of a full pairwise computation.
    """
    dim, take = qx.shape[1], min(k, len(rid))
    nq, nr = np.einsum("ij,ij->i", qx, qx), np.einsum("ij,ij->i", rx, rx)
    parts = [(qid[:0], rid[:0], np.empty(0))]
    step = max(1, BUDGET // max(1, len(rid)))
    for s in range(0, len(qx), step):
        c = slice(s, s + step)
        d2 = nq[c, None] + nr[None, :] - 2.0 * (qx[c] @ rx.T)
        bound = (4 * dim + 16) * EPS * (nq[c, None] + nr[None, :])
        own = qid[c, None] == rid[None, :]
        high, low = np.where(own, np.inf, d2 + bound), np.where(own, np.inf, d2 - bound)
        kth = np.partition(high, take - 1, axis=1)[:, take - 1]
        near = (low <= kth[:, None]) & ~own
        width = max(1, int(near.sum(axis=1).max()))
        at = np.argsort(np.where(near, low, np.inf), axis=1, kind="stable")[:, :width]
        valid = np.take_along_axis(near, at, axis=1)
        sub = max(1, BUDGET // max(1, width * dim))
        for t in range(0, at.shape[0], sub):
            u = slice(t, t + sub)
            diff = qx[c][u][:, None, :] - rx[at[u]]
            dist = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
            dist[~valid[u]] = np.inf
            other = rid[at[u]]
            order = np.lexsort((other, dist), axis=1)[:, :take]
            found = np.take_along_axis(dist, order, axis=1)
            ok = np.isfinite(found)
            ids = np.repeat(qid[c][u], order.shape[1]).reshape(-1, order.shape[1])
            parts.append((ids[ok], np.take_along_axis(other, order, axis=1)[ok], found[ok]))
    return tuple(np.concatenate(p) for p in zip(*parts))


def _codes(*ids: pd.Series) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ids of any type as their places in sorted order, which order as they do."""
    names, codes = np.unique(np.concatenate([i.to_numpy() for i in ids]), return_inverse=True)
    return names, np.split(codes, np.cumsum([len(i) for i in ids])[:-1])


def _within(k: int):
    """A whole class: (id, label, nbr_rank, nbr_id, distance)."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, (ids,) = _codes(rows["id"])
        x = _matrix(rows["features"])
        q, r, d = nearest(ids, x, ids, x, k)
        rank = pd.Series(q).groupby(q).cumcount().to_numpy() + 1
        return pd.DataFrame({"id": names[q], "label": rows["label"].iloc[0], "nbr_rank": rank.astype(np.int32), "nbr_id": names[r], "distance": d})
    return run


@dataclass(frozen=True)
class _Cells:
    """Of one class: pivots, and of each block its number, cell, distances of its nearest and farthest row, and rows."""
    pivots: np.ndarray
    number: np.ndarray
    cell: np.ndarray
    least: np.ndarray
    most: np.ndarray
    rows: np.ndarray

    def distances(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.pivots)))
        step = max(1, BUDGET // self.pivots.size)
        for s in range(0, len(x), step):
            diff = x[s:s + step, None, :] - self.pivots[None]
            out[s:s + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
        return out

    def visits(self, x: np.ndarray, kth: np.ndarray, k: int, own: int) -> list[np.ndarray]:
        """For each row, whose k-th nearest distance in its own block is given (infinite: too few), the blocks to visit."""
        to = self.distances(x)
        far = to[:, self.cell] + self.most                          # no row of the block is farther
        by = np.argsort(far, axis=1)
        enough = (np.cumsum(self.rows[by], axis=1) > k).argmax(axis=1)     # k besides the row itself
        known = np.where(self.rows.sum() > k, np.take_along_axis(far, by, 1)[np.arange(len(x)), enough], np.inf)
        reach = np.minimum(kth, known)
        between = self.distances(self.pivots)
        home = to.argmin(axis=1)
        apart = between[home]                                       # from the row's own pivot to the others
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = np.where(apart > 0, (to ** 2 - to[np.arange(len(x)), home][:, None] ** 2) / (2 * apart), 0.0)
        low = np.maximum(np.maximum(to[:, self.cell] - self.most, self.least - to[:, self.cell]), plane[:, self.cell])
        slack = SLACK * (1.0 + to[:, self.cell] + np.where(np.isfinite(reach), reach, 0.0)[:, None])
        ok = (low - slack <= reach[:, None]) & (self.number != own)
        return [self.number[row] for row in ok]


def _assign(cells: dict):
    """(id, label, features) with each row's cell and its distance to the pivot; the vectors stay in the batch's buffers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            labels, vectors = rows.column(1), rows.column(2)
            if pc.count_distinct(vectors.value_lengths()).as_py() > 1:
                raise ValueError("vectors of several lengths")
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
            cell, dist = np.zeros(rows.num_rows, np.int32), np.zeros(rows.num_rows)
            step = max(1, BUDGET // max(1, x.shape[1]))
            for name in labels.unique():
                mine = np.flatnonzero(pc.equal(labels, name).to_numpy(zero_copy_only=False))
                for s in range(0, len(mine), step):
                    at = mine[s:s + step]
                    to = cells[name.as_py()].distances(x[at])
                    cell[at], dist[at] = to.argmin(axis=1), to.min(axis=1)
            yield pa.record_batch([*rows.columns, pa.array(cell), pa.array(dist)], ["id", "label", "features", "cell", "dist"])
    return run


def _local(k: int, cells: dict):
    """A block: its rows with their neighbours inside it and the blocks they have to visit."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        names, (ids,) = _codes(rows["id"])
        x = _matrix(rows["features"])
        q, r, d = nearest(ids, x, ids, x, k)
        by = np.argsort(q, kind="stable")
        q, r, d = q[by], r[by], d[by]
        at = np.searchsorted(q, ids)
        many = np.searchsorted(q, ids, "right") - at
        kth = np.array([d[a + k - 1] if n >= k else np.inf for a, n in zip(at, many)])
        near = [[{"distance": float(d[j]), "nbr_id": names[r[j]]} for j in range(a, a + n)] for a, n in zip(at, many)]
        here, block, visit = cells[rows["label"].iloc[0]], int(rows["block"].iloc[0]), []
        step = max(1, BUDGET // (8 * len(here.number)))
        for s in range(0, len(x), step):
            visit += here.visits(x[s:s + step], kth[s:s + step], k, block)
        return rows[["id", "label", "features"]].assign(reach=kth, near=near, visit=visit)
    return run


def _visited(k: int):
    def run(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"id": q["id"].iloc[:0], "label": q["label"].iloc[:0], "nbr_id": q["id"].iloc[:0], "distance": np.empty(0)})
        if q.empty or r.empty:
            return empty
        names, (qid, rid) = _codes(q["id"], r["id"])
        a, b, d = nearest(qid, _matrix(q["features"]), rid, _matrix(r["features"]), k)
        reach = dict(zip(qid.tolist(), q["reach"].tolist()))
        ok = d <= np.array([reach[i] for i in a.tolist()])
        return pd.DataFrame({"id": names[a[ok]], "label": q["label"].iloc[0], "nbr_id": names[b[ok]], "distance": d[ok]})
    return run


@dataclass(frozen=True)
class Search:
    """The tables of the second round of large classes."""
    asked: DataFrame            # id, label, features, reach, near, visit (block numbers)
    blocked: DataFrame          # id, label, features, block
    parts: DataFrame            # label, block, parts: tasks that a block's visitors are dealt to

    def copies(self) -> int:
        """Vectors that the second round sends: one for each visit, and a block's own for each of its tasks."""
        visits = self.asked.agg(F.sum(F.size("visit"))).first()[0] or 0
        return visits + (self.blocked.join(self.parts, ["label", "block"]).agg(F.sum("parts")).first()[0] or 0)


def plan_search(rows: DataFrame, sizes: dict, k: int, block_size: int) -> Search:
    """The first round over classes of more than ``block_size`` rows; ``rows``: (id, label, features), ``sizes`` by class."""
    kind, kind_of_label = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    wanted = {name: min(MOST_PIVOTS, 2 * -(-n // block_size)) for name, n in sizes.items()}
    least = F.row_number().over(Window.partitionBy("label").orderBy(keyed_hash(17, "id"), "id"))
    drawn = rows.withColumn("_rn", least).where(F.col("_rn") <= max(wanted.values())).drop("_rn")
    pivots: dict = {}
    for r in drawn.orderBy("label", keyed_hash(17, "id"), "id").select("label", "features").collect():     # at most MOST_PIVOTS a class
        if len(pivots.setdefault(r["label"], [])) < wanted[r["label"]]:
            pivots[r["label"]].append(r["features"])
    none = np.empty(0)
    bare = {name: _Cells(np.unique(np.array(p, np.float64), axis=0), none, none, none, none, none) for name, p in pivots.items()}

    schema = f"id {kind}, label {kind_of_label}, features array<double>"
    placed = cut_lineage(rows.mapInArrow(_assign(bare), f"{schema}, cell int, dist double"))
    cell = ["label", "cell"]
    radius = placed.groupBy(*cell).agg(F.max("dist").alias("radius"))
    ring = F.when(F.col("radius") > 0, F.floor(F.col("dist") / F.col("radius") * RINGS)).otherwise(0).cast("int")
    ringed = placed.join(radius, cell).withColumn("ring", ring).drop("radius")
    upto = Window.partitionBy(*cell).orderBy("ring").rowsBetween(Window.unboundedPreceding, -1)
    shells = ringed.groupBy(*cell, "ring").agg(F.count(F.lit(1)).alias("n")) \
        .select(*cell, "ring", F.floor(F.coalesce(F.sum("n").over(upto), F.lit(0)) / block_size).alias("shell"),
                F.ceil(F.col("n") / block_size).alias("subs"))
    # Rows of one distance can't be told apart by shells; more than a block of them are dealt out by a hash of the id.
    cut = ringed.join(shells, [*cell, "ring"]).withColumn("sub", F.when(F.col("subs") > 1, 1 + F.pmod(F.xxhash64("id"), "subs")).otherwise(0))
    cut = cut_lineage(cut.select("id", "label", "features", "cell", "dist", "shell", "sub"))
    keys = [*cell, "shell", "sub"]
    blocks = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.min("dist").alias("least"), F.max("dist").alias("most"))
    found = sorted(tuple(r) for r in blocks.collect())                       # at most about 2 * MOST_BLOCKS and a cell each
    numbered = cut.sparkSession.createDataFrame([(*b[:4], i) for i, b in enumerate(found)],
                                                f"label {kind_of_label}, cell int, shell long, sub long, block int")
    cells = {}
    for name, c in bare.items():
        mine = [(i, b[1], b[5], b[6], b[4]) for i, b in enumerate(found) if b[0] == name]
        number, of, low, high, n = (np.array(v) for v in zip(*mine))
        cells[name] = _Cells(c.pivots, number.astype(np.int32), of.astype(np.int64), low, high, n)
    blocked = cut_lineage(cut.join(numbered, keys).select("id", "label", "features", "block"))
    asked = cut_lineage(blocked.groupBy("label", "block").applyInPandas(
        _local(k, cells), f"{schema}, reach double, near array<struct<distance: double, nbr_id: {kind}>>, visit array<int>"))
    parts = asked.select("label", F.explode("visit").alias("block")).groupBy("label", "block") \
        .agg(F.ceil(F.count(F.lit(1)) / block_size).cast("int").alias("parts"))
    return Search(asked, blocked, cut_lineage(parts))


def _search(rows: DataFrame, sizes: dict, k: int, block_size: int) -> DataFrame:
    kind, kind_of_label = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    plan = plan_search(rows, sizes, k, block_size)
    keys = ["label", "block", "part"]
    visitors = plan.asked.select("id", "label", "features", "reach", F.explode("visit").alias("block")).join(plan.parts, ["label", "block"]) \
        .withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    homes = plan.blocked.join(plan.parts, ["label", "block"]) \
        .select(F.col("id").alias("id"), F.col("label").alias("label"), F.col("features").alias("features"), F.col("block").alias("block"),
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    away = visitors.groupBy(*keys).cogroup(homes.groupBy(*keys)).applyInPandas(
        lambda q, r: _visited(k)(q, r), f"id {kind}, label {kind_of_label}, nbr_id {kind}, distance double")
    here = plan.asked.select("id", "label", F.explode("near").alias("n")).select("id", "label", "n.nbr_id", "n.distance")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "nbr_id"))
    return here.union(away).withColumn("nbr_rank", rank).where(F.col("nbr_rank") <= k).select("id", "label", "nbr_rank", "nbr_id", "distance")


def block_rows(dimensions: int, total: int, k: int, most: int) -> int:
    """Rows of a block, at most ``most``: they hold ``BLOCK_BYTES``, and there are no more than ``MOST_BLOCKS`` of ``total`` rows."""
    room = BLOCK_BYTES // (8 * max(1, dimensions))
    return max(1, min(most, max(k + 1, room)), -(-total // MOST_BLOCKS))


def class_sizes(df: DataFrame, label: str = "label") -> dict:
    """Rows by class; the classes are taken to be few, and it is an error if they are not."""
    found = df.groupBy(label).count().limit(MOST_CLASSES + 1).collect()
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes in {label!r}")
    return {r[0]: r[1] for r in found}


def knn_within_class(df: DataFrame, k: int = 5, block_size: int = 16_384, classes: DataFrame | None = None, key: str = "id",
                     label: str = "label", features: str = "features", materialize: bool = True, sizes: dict | None = None) -> DataFrame:
    """(id, label, nbr_rank 1..k, nbr_id, distance): the exact k nearest rows of the same class, ties to the smaller id.

    ``sizes``: the rows of each class, where the caller has counted them.

    Ids are unique.  A class of one row has no neighbours, one of at most k has all others.  Rows without features, and
    classes not in ``classes`` (if given), take no part.
    """
    ship_package(df.sparkSession)
    rows = df.select(F.col(key).alias("id"), F.col(label).alias("label"), F.col(features).cast("array<double>").alias("features"))
    rows = rows.where("features IS NOT NULL AND label IS NOT NULL")
    kind, kind_of_label = rows.schema["id"].dataType.simpleString(), rows.schema["label"].dataType.simpleString()
    if classes is not None:
        rows = rows.join(F.broadcast(classes.select(F.col(label).alias("label"))), "label", "left_semi").select("id", "label", "features")
    if materialize:
        rows = cut_lineage(rows)
    sizes = class_sizes(rows) if sizes is None else sizes
    if max(sizes.values(), default=0) > min(block_size, SMALL):
        first = rows.select(F.size("features")).first()
        block_size = block_rows(first[0] if first else 1, sum(sizes.values()), k, block_size)
    large = {name: n for name, n in sizes.items() if n > block_size}
    out = f"id {kind}, label {kind_of_label}, nbr_rank int, nbr_id {kind}, distance double"
    few = rows.where(~F.col("label").isin(list(large))) if large else rows
    small = few.groupBy("label").applyInPandas(_within(k), out)
    if not large:
        return small
    return small.union(_search(rows.where(F.col("label").isin(list(large))), large, k, block_size))
