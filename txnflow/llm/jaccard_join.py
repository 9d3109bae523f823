"""Jaccard join of word shingles by signature trees, exact.

1. Equal texts are one node.  Each piece of a few MB of nodes sends its distinct shingles, packed by hash range; a range
   adds them up and tells each piece which of its shingles occur in two nodes or more, and in how many.
2. All shingles that two similar documents share are repeated ones, and they are at least ``percent`` of each; a node
   with fewer is out, which most are.  Of the others' shingles, in order of rarity, those that a similar document can't
   lack all of are its keys.  Nodes with equal sets are linked at once, one of them goes on.
3. The smallest node under a key leads it.  A leader and its members are one group, so similar nodes share a group.
   A group of more than a bounded volume is split: by size class, as similar sets differ by a class at most, and by
   hash, the leader in every block.
4. Inside a block, nodes become the leaves of a signature tree: inner nodes hold the OR of their records' token bitmaps,
   the range of their sizes and the largest number of tokens that share a bit.  The tree is traversed against itself from
   the root: a pair of tree nodes is left when its sizes are too far apart, or when the bits both have, and the tokens that
   may hide behind them, are too few for the overlap the threshold asks.  Record pairs that are left and not yet
   connected are compared on their sets.
5. Blocks of a split group: the links found so far are contracted.  The members outside the group's most frequent component
   ask all blocks of the neighbouring size classes, tree against tree.  Every pair that shares a key is thus
   compared, ruled out by a bound, or already connected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm import shingles, wordbytes
from txnflow.llm.tables import written
from txnflow.llm.unionfind import components

PIECE_BYTES = 4 << 20
RANGE_SHINGLES = 1 << 20       # of one hash range; the number of ranges grows with the corpus
BLOCK_SHINGLES = 64_000        # of one block of a group
FAN = 8                        # children of a tree node
PAIRS = 2048                   # pairs of tree nodes whose children are looked at together
BITMAP_BYTES = 16 << 20        # of all leaves of a tree


# Repeated shingles --------------------------------------------------------------------------------------------------

def _numbered(size: int):
    """Distinct texts (digest, oid, text) to nodes: a number, the number of their piece, set size and set digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done = TaskContext.get().partitionId() << 33, 0
        for number, piece in enumerate(wordbytes.pieces(batches, "text", PIECE_BYTES)):
            elements, bounds = shingles.shingle_sets(wordbytes.scan(piece.column(2), wordbytes.FOLDED), size)
            d1, d2 = shingles.set_digests(elements, bounds)
            rows = piece.num_rows
            yield pa.record_batch([*piece.columns, pa.array(task + done + np.arange(rows)), pa.array(np.full(rows, task + number)),
                                   pa.array(np.diff(bounds)), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64))],
                                  ["digest", "oid", "text", "node", "piece", "n", "d1", "d2"])
            done += rows
    return run


NODES = "digest binary, oid long, text string, node long, piece long, n long, d1 long, d2 long"


def _pack(ascending: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 32-bit values, as differences, and a count of each; byte planes compress well."""
    steps = np.diff(ascending, prepend=np.uint32(0)).astype("<u4")
    planes = np.concatenate([steps, np.minimum(counts, (1 << 32) - 1).astype("<u4")]).view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(4, -1)
    values = np.ascontiguousarray(planes.T).view("<u4").ravel()
    half = len(values) // 2
    return np.cumsum(values[:half], dtype=np.uint32), values[half:].astype(np.int64)


def _short(elements: np.ndarray, bits: int) -> np.ndarray:
    """The leading bits + 32 bits of each shingle: the number of its hash range, and 32 more.

    Shingles that agree in these are counted as one, which makes them look more frequent and costs only time.
    """
    return elements >> np.uint64(32 - bits)


def _sent(size: int, bits: int):
    """Nodes (piece, text) to (range, piece, packed): the distinct shingles of a piece and in how many of its nodes they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in wordbytes.pieces(batches, "text", PIECE_BYTES):
            numbers = batch.column(0).to_numpy()
            cut = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(numbers)]):
                elements, _ = shingles.shingle_sets(wordbytes.scan(batch.column(1).slice(lo, hi - lo), wordbytes.FOLDED), size)
                values, counts = np.unique(_short(elements, bits), return_counts=True)
                of = (values >> np.uint64(32)).astype(np.int64)
                at = np.concatenate([[0], np.flatnonzero(np.diff(of)) + 1, [len(of)]]) if len(of) else np.zeros(1, np.int64)
                ranges = of[at[:-1]]
                packed = [_pack(values[a:b].astype(np.uint32), counts[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.record_batch([pa.array(ranges), pa.array(np.full(len(ranges), numbers[lo])), pa.array(packed, pa.binary())],
                                      ["range", "piece", "packed"])
    return run


def _repeated(table: pa.Table) -> pa.Table:
    """The rows of one hash range with only those shingles that two nodes or more have, and the number of these."""
    rows = [_unpack(p) for p in table["packed"].to_pylist()]
    values = np.concatenate([v for v, _ in rows])
    by = np.argsort(values, kind="stable")
    ordered = values[by]
    begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    totals = np.add.reduceat(np.concatenate([c for _, c in rows])[by], begin)
    known = ordered[begin][totals > 1]
    totals = totals[totals > 1]
    packed = []
    for v, _ in rows:
        at = np.minimum(np.searchsorted(known, v), max(len(known) - 1, 0))
        hit = known[at] == v if len(known) else np.zeros(len(v), bool)
        packed.append(_pack(v[hit], totals[at[hit]]) if hit.any() else None)
    return pa.table({"range": table["range"], "piece": table["piece"], "packed": pa.array(packed, pa.binary())}).drop_null()


def _routed(size: int, percent: int, bits: int):
    """A piece's nodes and its repeated shingles to the nodes that may be similar to others, with their keys."""
    def run(nodes: pa.Table, repeated: pa.Table) -> pa.Table:
        packed = sorted(zip(repeated["range"].to_pylist(), repeated["packed"].to_pylist()))
        found = [(np.uint64(r << 32), *_unpack(p)) for r, p in packed]
        known = np.concatenate([np.empty(0, np.uint64), *[r | v.astype(np.uint64) for r, v, _ in found]])
        many = np.concatenate([np.empty(0, np.int64), *[c for _, _, c in found]])
        by = np.argsort(known, kind="stable")             # a piece that was read in two parts has a range twice
        known, many = known[by], many[by]
        elements, bounds = shingles.shingle_sets(wordbytes.scan(nodes["text"], wordbytes.FOLDED), size)
        frequency = np.ones(len(elements), np.int64)
        if len(known):
            values = _short(elements, bits)
            at = np.minimum(np.searchsorted(known, values), len(known) - 1)
            frequency = np.where(known[at] == values, many[at], 1)
        n = np.diff(bounds)
        need = -(-percent * n // 100)
        shared = np.add.reduceat(np.append(frequency > 1, False), bounds[:-1]) * (n > 0) if len(n) else n
        going = np.flatnonzero((n > 0) & (shared >= need))
        keys = []
        for i in going.tolist():
            own = elements[bounds[i]:bounds[i + 1]]
            rarest = np.argsort(frequency[bounds[i]:bounds[i + 1]], kind="stable")
            keys.append(own[rarest[n[i] - shared[i]:n[i] - need[i] + 1]].view(np.int64))
        nodes = nodes.select(["node", "n", "d1", "d2", "text"]).take(pa.array(going))
        return nodes.append_column("keys", pa.array(keys, pa.list_(pa.int64())))
    return run


ROUTES = "node long, n long, d1 long, d2 long, text string, keys array<long>"


# Signature trees ----------------------------------------------------------------------------------------------------

class SignatureTree:
    """Sets as leaves, neighbours by their smallest element; each level ORs the bitmaps of ``FAN`` nodes of the one below."""

    def __init__(self, elements: np.ndarray, bounds: np.ndarray, records: np.ndarray, bits: int):
        first = elements[bounds[records]]
        self.records = records[np.argsort(first, kind="stable")]
        size = (bounds[self.records + 1] - bounds[self.records]).astype(np.int64)
        words = bits // 64
        bitmap = np.zeros(len(records) * words, np.uint64)
        at = np.concatenate([np.arange(lo, hi) for lo, hi in zip(bounds[self.records].tolist(), bounds[self.records + 1].tolist())])
        bit = elements[at] & np.uint64(bits - 1)
        place = np.repeat(np.arange(len(records)), size) * words + (bit >> np.uint64(6)).astype(np.int64)
        np.bitwise_or.at(bitmap, place, np.uint64(1) << (bit & np.uint64(63)))
        bitmap = bitmap.reshape(-1, words)
        hidden = size - np.bitwise_count(bitmap).sum(axis=1, dtype=np.int64)
        #: of each level, leaves first: bitmaps, smallest and largest size, largest number of tokens behind another's bit
        self.levels = [(bitmap, size, size, hidden)]
        while len(size) > FAN:
            at = np.arange(0, len(size), FAN)
            bitmap, low, high, hidden = self.levels[-1]
            size = np.minimum.reduceat(low, at)
            self.levels.append((np.bitwise_or.reduceat(bitmap, at, axis=0), size, np.maximum.reduceat(high, at), np.maximum.reduceat(hidden, at)))


def _possible(a, b, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Which node pairs may hold similar records: the sizes, then the largest possible overlap, against the threshold."""
    (bits_a, low_a, high_a, hidden_a), (bits_b, low_b, high_b, hidden_b) = a, b
    ok = np.flatnonzero(100 * np.minimum(high_a[i], high_b[j]) >= percent * np.maximum(low_a[i], low_b[j]))
    i, j = i[ok], j[ok]
    most = np.bitwise_count(bits_a[i] & bits_b[j]).sum(axis=1, dtype=np.int64) + np.minimum(hidden_a[i], hidden_b[j])
    return ok[(100 + percent) * most >= percent * (low_a[i] + low_b[j])]


def dual_traversal(x: SignatureTree, y: SignatureTree, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of leaf positions that no bound rules out, in portions; of a tree with itself, each pair once."""
    top = min(len(x.levels), len(y.levels)) - 1
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(x.levels[top][1])), np.arange(len(y.levels[top][1])), indexing="ij"))
    stack = [(top, i, j)]
    while stack:
        level, i, j = stack.pop()
        if len(i) > PAIRS:
            stack += [(level, i[at:at + PAIRS], j[at:at + PAIRS]) for at in range(0, len(i), PAIRS)]
            continue
        if x is y:
            once = i < j if level == 0 else i <= j
            i, j = i[once], j[once]
        ok = _possible(x.levels[level], y.levels[level], i, j, percent)
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if level == 0:
            yield i, j
            continue
        child = np.arange(FAN)
        i, j = (v.ravel() for v in np.broadcast_arrays(i[:, None, None] * FAN + child[:, None], j[:, None, None] * FAN + child))
        there = (i < len(x.levels[level - 1][1])) & (j < len(y.levels[level - 1][1]))
        stack.append((level - 1, i[there], j[there]))


class _Forest:
    """Union-find over positions; ``links`` are the unions made."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.root(x), self.root(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((x, y))


def _tree_bits(largest: int, records: int) -> int:
    """Bits of a bitmap: four a token of the largest set, within bounds, and fewer where there are many sets."""
    room = 1 << max(6, int(math.log2(max(64, 8 * BITMAP_BYTES // records))))
    return min(room, 1 << 14, 1 << max(8, int(4 * largest).bit_length()))


def block_links(elements: np.ndarray, bounds: np.ndarray, asking: np.ndarray, answering: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Similar records among ``answering`` if nobody asks, else of ``asking`` with ``answering``: links that connect them all."""
    sizes = np.diff(bounds)
    both = np.concatenate([asking, answering])
    bits = _tree_bits(int(sizes[both].max()), len(both))
    y = SignatureTree(elements, bounds, answering, bits)
    x = SignatureTree(elements, bounds, asking, bits) if len(asking) else y
    forest = _Forest(len(sizes))
    for i, j in dual_traversal(x, y, percent):
        a, b = x.records[i], y.records[j]
        by = np.argsort(a, kind="stable")
        a, b = a[by], b[by]
        cut = np.flatnonzero(np.diff(a)) + 1
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(a)]):
            one = int(a[lo])
            root = forest.root(one)
            others = np.array([k for k in b[lo:hi].tolist() if forest.root(k) != root], np.int64)
            if not len(others):
                continue
            own = elements[bounds[one]:bounds[one + 1]]
            theirs = np.concatenate([elements[bounds[k]:bounds[k + 1]] for k in others.tolist()])
            hit = own[np.minimum(np.searchsorted(own, theirs), len(own) - 1)] == theirs
            common = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[others])[:-1]]))
            for k in others[100 * common >= percent * (len(own) + sizes[others] - common)].tolist():
                forest.join(one, k)
    return forest.links


# Groups ---------------------------------------------------------------------------------------------------------------

_BLOCK = ("leader", "class", "x", "y")


def _solve(size: int, percent: int):
    """Rows sorted by block with role (0 asks, 1 answers), node and text to links (a, b), a < b."""
    def solve(table: pa.Table) -> pa.RecordBatch:
        elements, bounds = shingles.shingle_sets(wordbytes.scan(table["text"], wordbytes.FOLDED), size)
        role, node = table["role"].to_numpy(), table["node"].to_numpy()
        cut = _changes(table) + 1
        found = []
        for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), len(node)]):
            first = lo + int(np.searchsorted(role[lo:hi], 1))
            if first == hi or hi - lo == 1:
                continue
            found += block_links(elements, bounds, np.arange(lo, first), np.arange(first, hi), percent)
        ends = np.sort(node[np.array(found, np.int64).reshape(-1, 2)], axis=1)
        ends = ends[ends[:, 0] < ends[:, 1]]
        return pa.record_batch([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, volume = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            volume += batch.nbytes
            if volume < PIECE_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = _changes(table)
            whole = int(last[-1]) + 1 if len(last) else 0              # rows before the last block, which may go on
            if whole:
                yield solve(table.slice(0, whole))
            held, volume = table.slice(whole).to_batches(), 0
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())
    return run


def _changes(table: pa.Table) -> np.ndarray:
    """Rows after which another block begins."""
    return np.flatnonzero(np.any([np.diff(table[c].to_numpy()) != 0 for c in _BLOCK], axis=0))


def _solved(rows: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """``rows``: (leader, class, x, y, role, node).  Fetch the texts, bring each block together and return its links."""
    rows = rows.join(texts, "node").select(*_BLOCK, "role", "node", "text").repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "role", "node")
    return written(rows.mapInArrow(_solve(size, percent), "a long, b long"), name)


def _part(of: str, parts: str):
    return F.pmod(F.xxhash64(F.col(of)), F.col(parts))


def _parts(volume):
    return (F.floor(volume / BLOCK_SHINGLES) + 1).cast("long")


def _upto(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))


def _group_links(routes: DataFrame, size: int, percent: int) -> DataFrame:
    """Links (a, b) between similar nodes of different sets, which connect all that are linked."""
    zero = F.lit(0).cast("long")
    texts = routes.select("node", "text")
    keyed = routes.select("node", "n", F.explode("keys").alias("key"))
    leaders = written(keyed.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("nodes")).where("nodes > 1").drop("nodes"), "leaders")
    pairs = written(keyed.join(leaders, "key").where("node != leader").select("leader", "node", "n").distinct(), "pairs")
    total = pairs.groupBy("leader").agg(F.sum("n").alias("total"))
    # Sets of one class differ by a factor of 100 / percent at most, so similar ones are at most a class apart.
    base = F.floor(F.log(F.col("n")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    pairs = written(pairs.join(total, "leader").withColumn("class", F.when(F.col("total") > BLOCK_SHINGLES, base.cast("long")).otherwise(zero))
                    .withColumn("split", F.col("total") > BLOCK_SHINGLES).drop("total"), "members")
    blocks = written(pairs.groupBy("leader", "class", "split").agg(_parts(F.sum("n")).alias("ys")), "blocks")
    placed = pairs.join(blocks.drop("split"), ["leader", "class"])
    led = blocks.select("leader", "class", zero.alias("x"), _upto("ys").alias("y"), F.lit(1).alias("role"), F.col("leader").alias("node"))
    inside = placed.select("leader", "class", zero.alias("x"), _part("node", "ys").alias("y"), F.lit(1).alias("role"), "node")
    links = _solved(led.union(inside), texts, size, percent, "inside")

    near = written(components(links), "near")
    large = written(pairs.where("split").select("leader", "class", "node", "n").join(near, "node", "left")
                    .withColumn("component", F.coalesce("component", "node")), "large")
    hub = large.groupBy("leader", "component").count().groupBy("leader") \
        .agg(F.max_by("component", F.struct("count", "component")).alias("hub"))
    apart = large.join(hub, "leader").where("component != hub") \
        .select("leader", "node", "n", F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1)).alias("class"))
    apart = written(apart.join(blocks.where("split").drop("split"), ["leader", "class"]), "apart")
    asked = written(apart.groupBy("leader", "class").agg(_parts(F.sum("n")).alias("xs")), "asked")
    asking = apart.join(asked, ["leader", "class"]) \
        .select("leader", "class", _part("node", "xs").alias("x"), _upto("ys").alias("y"), F.lit(0).alias("role"), "node")
    answering = placed.where("split").join(asked, ["leader", "class"]) \
        .select("leader", "class", _upto("xs").alias("x"), _part("node", "ys").alias("y"), F.lit(1).alias("role"), "node")
    return links.union(_solved(asking.union(answering), texts, size, percent, "between"))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` (long), n_shingles, component_id.

    A document's set: the distinct shingles of ``shingle`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer
    words, the whole sequence as one.  Null, empty and blank texts have the empty set and are linked with nothing: their
    component is their own id.  Documents with 100 * intersection >= percent * union are linked; component_id is the
    smallest id that can be reached, the document's own included.  A null id comes after all others; a component of null
    ids alone is null.  Rows that repeat an id are judged by their own texts; equal rows get equal answers.  No
    rows give none; other columns play no part.  Sets are compared by 64-bit hashes of their shingles.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("oid"), F.col(text_col).alias("text"))
    digest = F.unhex(F.sha2("text", 256))
    texts = rows.where("text IS NOT NULL").groupBy(digest.alias("digest")).agg(F.min("oid").alias("oid"), F.any_value("text").alias("text"))
    nodes = written(texts.mapInArrow(_numbered(shingle), NODES), "nodes")
    volume = nodes.agg(F.sum("n")).first()[0] or 0
    bits = min(31, max(0, math.ceil(math.log2(max(volume, 1) / RANGE_SHINGLES))))

    sent = nodes.where("n > 0").select("piece", "text").mapInArrow(_sent(shingle, bits), "range long, piece long, packed binary")
    repeated = written(sent.groupBy("range").applyInArrow(_repeated, "range long, piece long, packed binary"), "repeated")
    routes = written(nodes.where("n > 0").groupBy("piece").cogroup(repeated.withColumnRenamed("piece", "of").groupBy("of"))
                     .applyInArrow(_routed(shingle, percent, bits), ROUTES), "routes")
    sets = written(routes.groupBy("d1", "d2", "n").agg(F.min("node").alias("rep")), "sets")
    same = routes.select("node", "d1", "d2", "n").join(sets, ["d1", "d2", "n"]).where("node != rep") \
        .select(F.col("rep").alias("a"), F.col("node").alias("b"))
    links = same.union(_group_links(routes.join(sets.select(F.col("rep").alias("node")), "node", "left_semi"), shingle, percent))

    reached = written(components(links), "reached")
    inside = reached.union(reached.select("component", "component").distinct())
    named = written(nodes.select("node", "oid").join(inside, "node").groupBy("component").agg(F.min("oid").alias("least")), "named")
    answers = nodes.select("digest", "node", "n", "oid").join(inside.join(named, "component").select("node", "least"), "node", "left") \
        .select("digest", "n", F.coalesce("least", "oid").alias("least"))
    answers = written(answers, "answers")
    # Joined on a second key too, as token_counts does: Spark then splits the skewed partition of a much copied text.
    keys = ["digest", "lead"]
    lead = F.substring("digest", 1, 4)
    n = F.coalesce(F.col("n"), F.lit(0).cast("long"))
    return (rows.select("oid", digest.alias("digest")).withColumn("lead", lead)
            .join(answers.withColumn("lead", lead), keys, "left")
            .select(F.col("oid").alias(id_col), n.alias("n_shingles"), F.when(n > 0, F.col("least")).otherwise(F.col("oid")).alias("component_id")))
