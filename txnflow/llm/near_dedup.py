"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. Every document's shingle set gets a SuperMinHash signature.  Documents with equal sets form one class, a node
   with a number of its own; from here on it stands for them, so thousands of exact copies cost as much as one,
   and different texts of one id are different nodes.
2. The signature's bands are keys.  Nodes that share a key are candidates.  The smallest node under a key
   leads it, and only (leader, member) pairs are made: a key with n members gives n - 1 rows, not n squared.
   Members that meet in one batch are linked to a batch leader at once, so a key reaches its task once per
   batch, however many documents have it.
3. Members are compared with their leader on full sets, in tiles of bounded volume.
4. A member that is not similar to its leader may still be similar to another member.  The links found so far
   are contracted to components.  Of a leader's members, all but those in their most frequent component are
   compared with all of them, tile by tile: both sides are cut into blocks of bounded volume and a task holds one pair
   of blocks, so no group is gathered.  A tile returns a spanning forest of its links, fewer rows than it
   read.  Every pair of documents that share a band is thus decided exactly or already connected.
5. All links are contracted to components; a component is named by the smallest id of its documents.

With 45 bands of 5 places a pair at the threshold shares no band with probability (1 - 0.8^5)^45 < 2e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm import shingles, wordbytes
from txnflow.llm.tables import discard, listed, written
from txnflow.llm.unionfind import components, spanning

BANDS, ROWS = 45, 5
PIECE_BYTES = 4 << 20
HEADS_BATCH = 20_000           # documents whose keys are matched before any is sent
TILE_SHINGLES = 64_000        # of a block of a tile
SLOTS = 1 << 20                # of the filter of candidates' hashes
LAST = (1 << 63) - 1           # stands for a null id


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            words = wordbytes.scan(piece.column(1), wordbytes.FOLDED)
            elements, bounds = shingles.shingle_sets(words, size)
            n = np.diff(bounds)
            d1, d2 = shingles.set_digests(elements, bounds)
            keys = shingles.band_keys(shingles.superminhash(elements, bounds, BANDS * ROWS), BANDS).view(np.int64)
            full = n > 0
            offsets = np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)
            yield pa.record_batch([piece.column(0), pa.array(n), pa.array(d1.view(np.int64)), pa.array(d2.view(np.int64)),
                                   pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].ravel())), piece.column(2)],
                                  ["oid", "n", "d1", "d2", "bands", "tkey"])
    return run


def _batch_heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes (node, bands) to (key, head, member, count): the head's own row has the count of its key, the others 0."""
    held: list[pa.RecordBatch] = []

    def solve() -> pa.RecordBatch:
        node = np.concatenate([b.column(0).to_numpy() for b in held])
        keys = np.concatenate([b.column(1).flatten().to_numpy() for b in held])
        owner = np.repeat(node, BANDS)
        by = np.lexsort((owner, keys))
        keys, owner = keys[by], owner[by]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        begin = np.flatnonzero(new)
        size = np.diff(np.append(begin, len(keys)))
        count = np.zeros(len(keys), np.int64)
        count[begin] = size
        head = np.repeat(owner[begin], size)
        by = np.argsort(owner, kind="stable")       # a node's rows together are stored in little room
        return pa.record_batch([keys[by], head[by], owner[by], count[by]], ["key", "head", "member", "count"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= HEADS_BATCH:
            yield solve()
            held = []
    if held:
        yield solve()


def _similar(x: np.ndarray, others: np.ndarray, owner: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the sets in ``others`` (sorted elements and whose each is) are similar to the set ``x``."""
    low, high = np.searchsorted(others, x, "left"), np.searchsorted(others, x, "right")
    n = high - low
    at = np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    common = np.bincount(owner[at], minlength=len(sizes))
    return np.flatnonzero((100 * common >= percent * (len(x) + sizes - common)) & (common > 0))


def _links(size: int, percent: int):
    """Rows sorted by tile (leader, x, y) with role, node, text to (leader, a, b), a < b: a forest of the roles' links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(table: pa.Table) -> pa.RecordBatch:
            words = wordbytes.scan(table["text"], wordbytes.FOLDED)
            elements, bounds = shingles.shingle_sets(words, size)
            leader, x, y, role, node = (table[c].to_numpy() for c in ("leader", "x", "y", "role", "node"))
            cut = np.flatnonzero((np.diff(leader) != 0) | (np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            found = []
            for lo, hi in zip(np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(node)]]).tolist()):
                first = lo + int(np.searchsorted(role[lo:hi], 1))        # role 0 asks, role 1 answers
                if lo == first or first == hi:
                    continue
                sizes = np.diff(bounds[first:hi + 1])
                mine = elements[bounds[first]:bounds[hi]]
                by = np.argsort(mine, kind="stable")
                owner = np.repeat(np.arange(hi - first), sizes)[by]
                mine = mine[by]
                hits = [node[first + _similar(elements[bounds[i]:bounds[i + 1]], mine, owner, sizes, percent)] for i in range(lo, first)]
                a, b = spanning(np.repeat(node[lo:first], [len(h) for h in hits]), np.concatenate(hits))
                found.append((np.full(len(a), leader[lo]), a, b))
            out = [np.concatenate(c) for c in zip(*found)] if found else [np.empty(0, np.int64)] * 3
            return pa.record_batch([pa.array(c, pa.int64()) for c in out], ["leader", "a", "b"])

        held, volume = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            volume += batch.nbytes
            if volume < PIECE_BYTES:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            tile = [table[c].to_numpy() for c in ("leader", "x", "y")]
            last = np.flatnonzero(np.any([t != t[-1] for t in tile], axis=0))
            whole = int(last[-1]) + 1 if len(last) else 0               # rows before the last tile, which may go on
            if whole:
                yield solve(table.slice(0, whole))
            held, volume = table.slice(whole).to_batches(), 0
        if held:
            yield solve(pa.Table.from_batches(held).combine_chunks())
    return run


def _solved(tiles: DataFrame, texts: DataFrame, size: int, percent: int, name: str) -> DataFrame:
    """``tiles``: (leader, x, y, role, node).  Fetch the texts, bring each tile together and return its links."""
    rows = (tiles.join(texts, "node").select("leader", "x", "y", "role", "node", "text")
            .repartition("leader", "x", "y").sortWithinPartitions("leader", "x", "y", "role", "node"))
    return written(rows.mapInArrow(_links(size, percent), "leader long, a long, b long"), name)


def _block(of: str, blocks: str):
    return F.pmod(F.xxhash64(F.col(of)), F.col(blocks))


def near_links(classes: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """``classes`` (node, n, bands, oid, tkey) and ``texts`` (oid, tkey, text) to links (a, b) between nodes."""
    # Heads and members come from one pass: another scan may pack other rows into a batch and so have other heads.
    heads = written(classes.where("n > 0").select("node", "bands")
                    .mapInArrow(_batch_heads, "key long, head long, member long, count long"), "heads")
    # One row of a key and batch meets the others of its key, first to find the least, then to learn it.
    shared = heads.where("count > 0").select("key", "head", "count")
    least = written(shared.groupBy("key").agg(F.min("head").alias("leader"), F.sum("count").alias("nodes")).where("nodes > 1").drop("nodes"), "least")
    leaders = written(shared.select("key", "head").join(least, "key"), "leaders")
    rest = heads.where("count = 0").select("key", "head", "member").join(leaders, ["key", "head"])
    pairs = (leaders.select("leader", F.col("head").alias("member")).union(rest.select("leader", "member"))
             .where("leader != member").distinct().join(classes.select(F.col("node").alias("member"), "n"), "member"))
    pairs = written(pairs, "pairs")
    discard(heads, least, leaders)
    volume = written(pairs.groupBy("leader").agg(F.sum("n").alias("total")), "volume")
    nodes = pairs.select(F.col("member").alias("node")).union(volume.select("leader")).distinct()
    nodes = written(classes.select("node", "oid", "tkey").join(nodes, "node", "left_semi"), "nodes")
    # Most texts belong to no candidate.  They stay behind by a semi-join with the slots of the candidates' hashes, a
    # table of at most SLOTS rows; the candidates themselves grow with the corpus, and are never sent to every task.
    slot = F.pmod("tkey", F.lit(SLOTS))
    slots = F.broadcast(nodes.select(slot.alias("slot")).distinct())
    wanted = texts.join(slots, slot == F.col("slot"), "left_semi")
    # One text a node, also if its row is repeated; copies of a row are combined before the shuffle.
    texts = written(wanted.join(nodes.hint("merge"), ["oid", "tkey"]).groupBy("node").agg(F.any_value("text").alias("text")), "texts")

    blocks = (F.floor(F.col("total") / TILE_SHINGLES) + 1).cast("long")
    led = pairs.join(volume.withColumn("blocks", blocks).drop("total"), "leader")
    asking = (volume.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
              .select("leader", F.lit(0).cast("long").alias("x"), "y", F.lit(0).alias("role"), F.col("leader").alias("node")))
    answering = led.select("leader", F.lit(0).cast("long").alias("x"), _block("member", "blocks").alias("y"),
                           F.lit(1).alias("role"), F.col("member").alias("node"))
    linked = _solved(asking.union(answering), texts, size, percent, "linked")

    near = written(components(linked.select("a", "b")), "near").withColumnRenamed("node", "member")
    placed = written(pairs.join(near, "member", "left").withColumn("component", F.coalesce("component", "member")), "placed")
    hub = (placed.groupBy("leader", "component").count().groupBy("leader")
           .agg(F.max_by("component", F.struct("count", "component")).alias("hub"), F.count("*").alias("parts")).where("parts > 1"))
    apart = written(placed.join(hub, "leader").where("component != hub").select("leader", "member", "n"), "apart")
    asked = written(apart.groupBy("leader").agg(F.sum("n").alias("asked")).join(volume, "leader")
                    .select("leader", (F.floor(F.col("asked") / TILE_SHINGLES) + 1).cast("long").alias("xs"), blocks.alias("ys")), "asked")
    discard(volume, nodes, linked, placed)
    asking = (apart.join(asked, "leader")
              .select("leader", _block("member", "xs").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("ys") - 1)).alias("y"),
                      F.lit(0).alias("role"), F.col("member").alias("node")))
    answering = (pairs.join(asked, "leader")
                 .select("leader", F.explode(F.sequence(F.lit(0).cast("long"), F.col("xs") - 1)).alias("x"),
                         _block("member", "ys").alias("y"), F.lit(1).alias("role"), F.col("member").alias("node")))
    among = _solved(asking.union(answering), texts, size, percent, "among")
    discard(texts, pairs, apart, asked)
    return near.select(F.col("component").alias("a"), F.col("member").alias("b")).union(among.select("a", "b")).distinct()


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (oid, text, tkey); (oid, tkey) tells a row's text also among rows that repeat an id."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("oid"), F.col(text_col).alias("text"),
                       F.xxhash64(F.col(text_col)).alias("tkey"))


def _judged(docs: DataFrame, id_col: str, text_col: str, shingle: int, percent: int) -> DataFrame:
    """One row (oid, tkey, n, component) per row of ``docs``; component is the smallest oid that can be reached."""
    texts = _texts(docs, id_col, text_col)
    signed = written(texts.mapInArrow(_signatures(shingle), "oid long, n long, d1 long, d2 long, bands array<long>, tkey long"),
                     "signatures")
    # The numbers are unique and hold, as the table is written once.
    classes = written(signed.where("n > 0").groupBy("d1", "d2", "n")
                      .agg(F.min(F.struct("oid", "tkey")).alias("least"), F.any_value("bands").alias("bands"))
                      .select("d1", "d2", "n", "least.*", "bands", F.monotonically_increasing_id().alias("node")), "classes")
    links = written(near_links(classes, texts, shingle, percent), "near_links")
    found = written(components(links).withColumnRenamed("component", "root"), "found")
    inside = written(classes.select("node", "oid").join(found.union(found.select("root", "root").distinct()), "node"), "inside")
    named = inside.groupBy("root").agg(F.min("oid").alias("component"))
    named = written(inside.join(named, "root").select("node", "component"), "named")
    of_class = classes.select("d1", "d2", "n", "node", "oid").join(named, "node", "left") \
        .select("d1", "d2", "n", F.coalesce("component", "oid").alias("component"))
    return signed.select("oid", "tkey", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left") \
        .withColumn("component", F.coalesce("component", "oid"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: ``id_col`` (long), n_shingles, component_id, kept.

    A document's set: the distinct shingles of ``shingle`` words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer
    words, the whole sequence as one.  Null, empty and blank texts have the empty set and are linked with
    nothing.  Documents with 100 * intersection >= percent * union are linked; component_id is the smallest id that
    can be reached, the document's own included; kept says that it is the document's own.  A null id comes
    after all others, its component_id is null if nothing smaller is reached, and then it is kept.  Rows that repeat
    an id are judged by their own texts; equal rows get equal answers.
    """
    out = _judged(docs, id_col, text_col, shingle, percent)
    back = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return out.select(back("oid").alias(id_col), F.col("n").alias("n_shingles"), back("component").alias("component_id"),
                      (F.col("component") == F.col("oid")).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                         percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; rows that repeat an id go or stay by their own texts."""
    with listed() as used:
        kept = _judged(docs, id_col, text_col, shingle, percent).where("component = oid").select("oid", "tkey").distinct()
        kept = written(kept.toDF("__oid", "__tkey"), "kept")
    discard(*[t for t in used if t is not kept])
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__oid")) & (F.xxhash64(F.col(text_col)) == F.col("__tkey"))
    return docs.join(kept, same, "left_semi")
