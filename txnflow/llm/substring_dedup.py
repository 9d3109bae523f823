"""Removal of repeated passages by super-k-mer partitioning.

A window is ``window`` consecutive words of one document.  A window whose word
sequence also starts earlier (smaller id, or same document and smaller start) is
repeated, and every word that a repeated window covers is removed.

Sending each window somewhere would multiply the corpus by ``window``.  Instead each
window gets a *minimiser*, the smallest hash among its eight-word grams.  Neighbouring
windows mostly share it, so a maximal run of them -- a super-k-mer -- travels as one
packed string, and equal windows, having equal minimisers, meet in the same bucket.
There all windows are sorted by fingerprint; equal fingerprints are confirmed on the
words themselves, and all but the earliest window of a sequence are repeated.

A window whose minimiser stands at one place of the corpus only can't be repeated and does
not travel.  The places of minimisers, four bytes each, are counted first, and those that
stand at several places set a bit of a filter of 2^``FILTER_BITS`` bits, sent
to all tasks.  What passes the filter by chance is sent and compared like the rest.

Scale: a super-k-mer that occurs more than once in a map-side piece of text is sent
once, as its later occurrences are known to be repeated without asking anyone; a
passage that a third of all documents share thus reaches its bucket once per piece, not
once per document.  Runs are cut at 64 windows, so one long monotonous text makes
equal strings.  The number of buckets follows the volume of text.  A phrase that stands in
many documents amid different words can be the minimiser of a large volume of different
strings: bucket volumes are counted first, and the windows of an overfull bucket travel
one by one to sub-buckets by the hash of the whole window, again once per piece.

Most texts have no repeated window.  A filter like that of the minimisers says which may have one: only these meet their
spans by a shuffle, the others are returned where they are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnflow.llm import wordbytes
from txnflow.llm.tables import shuffles_removed, written

GRAM = 8                     # words of a minimiser, fewer for windows of less than 20 words
LONGEST_RUN = 64
PIECE_BYTES = 4 << 20
BUCKET_BYTES = 16 << 20      # of text; a bucket holds about three times as much
HOT_BYTES = 16 << 20         # of text; a bucket above this is split by whole windows
SLOT_BYTES = 64 << 20        # of text whose minimisers' places are counted together
ANCHORS = 1 << 21            # minimisers' places that a task holds before it sends them
FILTER_BITS = 27             # log2 of the filter's places: 16 MB
SPAN_SLOT_BITS = 6           # log2 of the parts that the filter of texts with spans is made in
LAST = (1 << 63) - 1         # the order of a null id: after all others

_SUPERS = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("oid", pa.list_(pa.int64())),
                     ("tkey", pa.list_(pa.int64())), ("lo", pa.list_(pa.int32())), ("hi", pa.list_(pa.int32()))])
_SUPERS_DDL = "bucket long, packed binary, oid array<long>, tkey array<long>, lo array<int>, hi array<int>"
_SPANS = pa.schema([("oid", pa.int64()), ("tkey", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_SPANS_DDL = "oid long, tkey long, lo int, hi int"
_SPAN_LIST = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _runs(position: np.ndarray, text: np.ndarray, minimiser: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and number of windows of each super-k-mer, from the windows' first words, texts and minimisers."""
    new = np.ones(len(position), bool)
    new[1:] = (np.diff(position) != 1) | (text[1:] != text[:-1]) | (minimiser[1:] != minimiser[:-1])
    begin = np.flatnonzero(new)
    since = np.arange(len(position)) - np.repeat(begin, np.diff(np.append(begin, len(position))))
    begin = np.flatnonzero(since % LONGEST_RUN == 0)
    return begin, np.diff(np.append(begin, len(position)))


def _gram(window: int) -> int:
    return min(window, max(3, GRAM * window // 20), GRAM)


class _Texts:
    """A piece by (oid, tkey): its words, their grams, and the windows that a repeated row does not repeat."""

    def __init__(self, piece: pa.RecordBatch, window: int):
        gram = _gram(window)
        table = pa.Table.from_batches([piece]).sort_by([("oid", "ascending"), ("tkey", "ascending")])
        self.ids, self.keys = table["oid"].to_numpy(), table["tkey"].to_numpy()
        self.words = wordbytes.scan(table["text"], wordbytes.SPACED).tight()
        self.hashes, self.text_of = self.words.hashes(), self.words.text_of()
        self.grams = wordbytes.grams(self.hashes, gram)
        self.least = least = wordbytes.sliding_min(self.grams, window - gram + 1)
        position = np.flatnonzero(self.words.first[1:][self.text_of[:len(least)]] >= np.arange(window, window + len(least)))
        same = np.zeros(len(self.ids), bool)          # a repeated row says nothing new
        same[1:] = (self.ids[1:] == self.ids[:-1]) & (self.keys[1:] == self.keys[:-1])
        self.position = position[~same[self.text_of[position]]]


def anchors(window: int, slot_bits: int):
    """Map side: (oid, tkey, text) batches to the places of minimisers, as (slot, packed 32-bit parts of their hashes).

    Every place whose gram is the minimiser of a window over it counts, so equal windows have two such places even
    where they overlap.  One that a task has more than once is sent twice.
    """
    wide = window - _gram(window)

    def slots(held: list[np.ndarray]) -> pa.RecordBatch:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        found = np.repeat(found, np.minimum(n, 2))
        slot = (found >> np.uint64(64 - slot_bits)).astype(np.int32)
        part = ((found << np.uint64(slot_bits)) >> np.uint64(32)).astype("<u4")
        cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        return pa.record_batch([pa.array(slot[cut]), pa.array([x.tobytes() for x in np.split(part, cut[1:])], pa.binary())], ["slot", "parts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            texts = _Texts(piece, window)
            if not len(texts.position):
                continue
            least = np.zeros(len(texts.least) + 2 * wide, np.uint64)
            least[texts.position + wide] = texts.least[texts.position]
            most = ~wordbytes.sliding_min(~least, wide + 1)
            held.append(wordbytes.mix(texts.grams[most == texts.grams]))
            size += len(held[-1])
            if size >= ANCHORS:
                yield slots(held)
                held, size = [], 0
        if size:
            yield slots(held)
    return run


def _repeated_anchors(slot_bits: int):
    """A slot's places of minimisers to its part of the filter: bits of the hashes that stand at several places."""
    def run(table: pa.Table) -> pa.Table:
        parts = np.sort(np.frombuffer(b"".join(table["parts"].to_pylist()), "<u4"))
        return _slot_bits_set(table["slot"], parts[1:][parts[1:] == parts[:-1]] >> np.uint32(32 - (FILTER_BITS - slot_bits)), slot_bits)
    return run


def _slot_bits_set(slot: pa.ChunkedArray, places: np.ndarray, slot_bits: int) -> pa.Table:
    bits = np.zeros(1 << FILTER_BITS - slot_bits, bool)
    bits[places] = True
    return pa.table({"slot": slot.slice(0, 1).cast(pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


@dataclass(frozen=True)
class Filter:
    """A bit for each value of a hash's first ``FILTER_BITS`` bits."""
    bits: Broadcast

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> np.uint64(64 - FILTER_BITS)
        return np.frombuffer(self.bits.value, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def repeated_filter(texts: DataFrame, window: int, volume: int) -> Filter:
    """Which minimisers may stand at several places of ``texts`` (oid, tkey, text), which have ``volume`` bytes."""
    slot_bits = min(max(4, (volume // SLOT_BYTES).bit_length()), FILTER_BITS - 3)
    return _filter(texts.mapInArrow(anchors(window, slot_bits), "slot int, parts binary").groupBy("slot")
                   .applyInArrow(_repeated_anchors(slot_bits), "slot int, bits binary"), slot_bits)


def _filter(slots: DataFrame, slot_bits: int) -> Filter:
    """The filter of parts (slot, bits)."""
    spark = slots.sparkSession
    with shuffles_removed(spark):
        found = slots.toArrow()
    bits = np.zeros((1 << slot_bits, 1 << FILTER_BITS - slot_bits - 3), np.uint8)
    for slot, part in zip(found["slot"].to_pylist(), found["bits"].to_pylist()):
        bits[slot] = np.frombuffer(part, np.uint8)
    return Filter(spark.sparkContext.broadcast(bits.tobytes()))


def _text_hash():
    return F.xxhash64("oid", "tkey")


def span_filter(spans: DataFrame) -> Filter:
    """Which texts may have ``spans`` (oid, tkey, ...)."""
    def run(table: pa.Table) -> pa.Table:
        hashes = table["hash"].to_numpy().view(np.uint64)
        return _slot_bits_set(table["slot"], hashes << np.uint64(SPAN_SLOT_BITS) >> np.uint64(64 - (FILTER_BITS - SPAN_SLOT_BITS)), SPAN_SLOT_BITS)

    slots = spans.select(F.shiftrightunsigned(_text_hash(), 64 - SPAN_SLOT_BITS).cast("int").alias("slot"), _text_hash().alias("hash"))
    return _filter(slots.groupBy("slot").applyInArrow(run, "slot int, bits binary"), SPAN_SLOT_BITS)


def super_kmers(window: int, buckets: int, hot: dict[int, int] | None = None, volumes: bool = False, wanted: Filter | None = None):
    """Map side: (oid, tkey, text) batches to super-k-mers by bucket, and spans already known to be repeated.

    ``hot``: overfull buckets and the number of sub-buckets that their single windows go to.  ``volumes``: only (bucket,
    volume) of the text that would be sent.  ``wanted``: only windows whose minimiser passes are looked at.
    """
    overfull = np.array(sorted(hot or {}), np.int64)
    splits = np.array([(hot or {})[b] for b in overfull.tolist()], np.int64)
    base_of = buckets + np.cumsum(splits) - splits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            texts = _Texts(piece, window)
            ids, keys, words, hashes, text_of, least = texts.ids, texts.keys, texts.words, texts.hashes, texts.text_of, texts.least
            position = texts.position
            if wanted is not None:
                position = position[wanted.passes(wordbytes.mix(least[position]))]
            if not len(position):
                continue
            begin, count = _runs(position, text_of[position], least[position])
            first, until = position[begin], position[begin] + count + window - 1
            data = words.data.tobytes()

            def merged(first: np.ndarray, until: np.ndarray) -> tuple[list[bytes], np.ndarray]:
                """The texts of the word ranges, in order, and which are known to be repeated.

                Rows are in order of id, so the first occurrence is the earliest; another at the same place
                (two texts of one id) is neither earlier nor later and is sent too.
                """
                owner = text_of[first]
                lo = first - words.first[owner]
                seen: dict[bytes, int] = {}
                lines = [data[x:y] for x, y in zip(words.start[first].tolist(), words.end[until - 1].tolist())]
                leader = np.fromiter((seen.setdefault(s, i) for i, s in enumerate(lines)), np.int64, len(lines))
                return lines, (ids[owner] > ids[owner[leader]]) | (lo > lo[leader])

            lines, later = merged(first, until)
            low, high = first[later], until[later]
            sent = np.flatnonzero(~later)
            bucket = (wordbytes.mix(least[first[sent]]) % np.uint64(buckets)).astype(np.int64)
            if volumes:
                sizes = words.end[until[sent] - 1] - words.start[first[sent]] + 1
                found, at = np.unique(bucket, return_inverse=True)
                yield pa.record_batch([pa.array(found), pa.array(np.bincount(at, sizes).astype(np.int64))], ["bucket", "volume"])
                continue
            lines, first, count = [lines[i] for i in sent.tolist()], first[sent], count[sent]
            over = np.isin(bucket, overfull)
            if over.any():
                n = count[over]
                at = np.repeat(first[over] - np.cumsum(n) + n, n) + np.arange(n.sum())
                which = np.repeat(np.searchsorted(overfull, bucket[over]), n)
                single, again = merged(at, at + window)
                low, high = np.r_[low, at[again]], np.r_[high, at[again] + window]
                prints = wordbytes.mix(wordbytes.grams(hashes, window)[at[~again]])
                which = which[~again]
                part = base_of[which] + (prints % splits[which].astype(np.uint64)).astype(np.int64)
                lines = [s for s, o in zip(lines, over.tolist()) if not o] + [s for s, o in zip(single, again.tolist()) if not o]
                first, bucket = np.r_[first[~over], at[~again]], np.r_[bucket[~over], part]
            owner = text_of[first]
            lo = first - words.first[owner]
            out = []
            if len(first):
                by = np.argsort(bucket, kind="stable")
                bucket = bucket[by]
                cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
                for x, y in zip(cut, np.r_[cut[1:], len(by)]):
                    part = by[x:y]
                    text = b"\n".join([lines[i] for i in part]) + b"\n"
                    out.append((int(bucket[x]), pack.compress(text), ids[owner[part]], keys[owner[part]], lo[part], None))
            if len(low):
                by = np.argsort(low, kind="stable")
                low, high = low[by], high[by]
                mine = text_of[low]
                new = np.r_[True, (low[1:] > np.maximum.accumulate(high)[:-1]) | (mine[1:] != mine[:-1])]
                x = np.flatnonzero(new)
                high = np.maximum.reduceat(high, x)
                mine = mine[x]
                base = words.first[mine]
                out.append((-1 - int(keys[0] % buckets), None, ids[mine], keys[mine], low[x] - base, high - base))
            yield pa.record_batch([pa.array(list(col), type=field.type) for col, field in zip(zip(*out), _SUPERS)],
                                  schema=_SUPERS)
    return run


def _confirmed(words: wordbytes.Words, at: np.ndarray, leader: np.ndarray, line: np.ndarray, window: int) -> bool:
    """Whether the windows at ``at`` have the words of those at ``leader``; neighbours are compared together."""
    other = np.flatnonzero(at != leader)
    if not len(other):
        return True
    p, q, mine = at[other], leader[other], line[other]
    new = np.r_[True, (np.diff(p) != 1) | (np.diff(q) != 1) | (mine[1:] != mine[:-1])]
    x = np.flatnonzero(new)
    n = np.diff(np.r_[x, len(p)]) + window - 1
    data = words.data.tobytes()
    a, b = words.start[p[x]].tolist(), words.end[p[x] + n - 1].tolist()
    c, d = words.start[q[x]].tolist(), words.end[q[x] + n - 1].tolist()
    return all(data[i:j] == data[k:m] for i, j, k, m in zip(a, b, c, d))


def repeated_in_bucket(window: int):
    """Reduce side: sort a bucket's windows and return the spans covered by repeated ones."""

    def run(table: pa.Table) -> pa.Table:
        known = table.filter(pa.compute.is_null(table["packed"]))
        if known.num_rows:
            return pa.table([pa.compute.list_flatten(known[c]).combine_chunks() for c in _SPANS.names], schema=_SPANS)
        if not table.num_rows:
            return _SPANS.empty_table()
        unpack = zstandard.ZstdDecompressor()
        lines = b"".join(unpack.decompress(x.as_py()) for x in table["packed"]).split(b"\n")[:-1]
        ids, keys, lo = (pa.compute.list_flatten(table[c]).combine_chunks().to_numpy() for c in ("oid", "tkey", "lo"))
        order = np.lexsort((keys, lo, ids))
        ids, keys, lo = ids[order], keys[order], lo[order].astype(np.int64)
        words = wordbytes.scan(pa.array([lines[i] for i in order], pa.large_binary()), wordbytes.SPACED)
        prints = wordbytes.grams(words.hashes(), window)
        line = words.text_of()[:len(prints)]
        at = np.flatnonzero(words.first[1:][line] >= np.arange(window, window + len(prints)))
        line, prints = line[at], prints[at]
        start = lo[line] + at - words.first[line]
        rank = (np.cumsum(np.r_[0, ids[1:] != ids[:-1]])[line] << 40) + start
        by = np.argsort(prints, kind="stable")
        group = np.flatnonzero(np.r_[True, np.diff(prints[by]) != 0])
        size = np.diff(np.r_[group, len(by)])
        leader = np.empty(len(by), np.int64)
        leader[by] = np.repeat(by[group], size)
        if _confirmed(words, at, at[leader], line, window):
            earliest = np.empty(len(by), np.int64)
            earliest[by] = np.repeat(np.minimum.reduceat(rank[by], group), size)
        else:                                   # two sequences with one fingerprint: group by the words themselves
            best: dict[bytes, int] = {}
            texts = [words.slice(i, i + window) for i in at.tolist()]
            for s, r in zip(texts, rank.tolist()):
                best[s] = min(r, best.get(s, r))
            earliest = np.array([best[s] for s in texts], np.int64)
        hit = np.flatnonzero(rank > earliest)
        if not len(hit):
            return _SPANS.empty_table()
        x = np.flatnonzero(np.r_[True, (np.diff(hit) != 1) | (line[hit][1:] != line[hit][:-1])])
        y = np.r_[x[1:], len(hit)] - 1
        mine = line[hit[x]]
        return pa.table([ids[mine], keys[mine], start[hit[x]].astype(np.int32),
                         (start[hit[y]] + window).astype(np.int32)], schema=_SPANS)
    return run


def without_spans(text_col: str):
    """Count words, remove those in ``spans`` and join the rest by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wordbytes.pieces(batches, text_col, PIECE_BYTES):
            words = wordbytes.scan(piece.column(piece.schema.get_field_index(text_col)), wordbytes.SPACED).tight()
            spans = piece.column(piece.num_columns - 1)
            inner = spans.flatten()
            owner = np.repeat(np.arange(len(spans)), spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            step = np.zeros(len(words.start) + 1, np.int64)
            for field, sign in (("lo", 1), ("hi", -1)):
                np.add.at(step, words.first[owner] + inner.field(field).to_numpy(), sign)
            kept = np.cumsum(step)[:-1] == 0
            n, total = words.counts(), np.concatenate([[0], np.cumsum(kept)])
            n_kept = total[words.first[1:]] - total[words.first[:-1]]
            lens = (words.end - words.start + 1) * kept
            ends = np.concatenate([[0], np.cumsum(lens)])[words.first]
            letters = np.repeat(kept, words.end - words.start + 1)
            out = words.data[letters]
            last = ends[1:][n_kept > 0] - 1            # the space after a text's last word
            keep = np.ones(len(out), bool)
            keep[last] = False
            offsets = ends - np.concatenate([[0], np.cumsum(n_kept > 0)])
            text = pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(offsets.astype(np.int64).tobytes()),
                                                    pa.py_buffer(out[keep].tobytes())).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*piece.columns[:-1], pa.array(n, pa.int64()), pa.array(n - n_kept, pa.int64()), text],
                [*piece.schema.names[:-1], "n_words", "n_removed", "kept_text"])
    return run


def without_any(text_col: str, some: Filter):
    """The same for the texts that do not pass ``some`` by the hash in the last column, and so have no spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def others() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rest = batch.filter(pa.array(~some.passes(batch.column(batch.num_columns - 1).to_numpy().view(np.uint64))))
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.nulls(rest.num_rows, _SPAN_LIST)], rest.schema.names)
        yield from without_spans(text_col)(others())
    return run


def repeated_spans(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Rows (oid, tkey, spans): the word ranges [lo, hi) of each text that repeated windows cover."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("oid"),
                        F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))
    volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), volume // BUCKET_BYTES)
    wanted = repeated_filter(texts, window, volume)
    # Few come to the driver: an overfull bucket has at least HOT_BYTES of text.
    with shuffles_removed(spark):
        full = (texts.mapInArrow(super_kmers(window, buckets, volumes=True, wanted=wanted), "bucket long, volume long").groupBy("bucket").agg(F.sum("volume").alias("volume"))
                .where(F.col("volume") > HOT_BYTES).collect())
    hot = {r.bucket: r.volume * (window // 2 + 1) // BUCKET_BYTES + 1 for r in full}
    spans = (texts.mapInArrow(super_kmers(window, buckets, hot, wanted=wanted), _SUPERS_DDL)
             .groupBy("bucket").applyInArrow(repeated_in_bucket(window), _SPANS_DDL)
             .groupBy("oid", "tkey").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")))
    return written(spans, "spans")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20) -> DataFrame:
    """``docs`` with n_words, n_removed (long) and kept_text.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; ``kept_text`` joins the words that stay by one space.
    Null and empty texts have no words and keep an empty text; texts shorter than ``window`` stay whole.
    A null id comes after all others.  Rows with the same id are judged as being at the same place, so a repeated
    row is not removed by its double, nor does it count as an earlier start.  All rows return; a column of
    ``docs`` that has the name of a new one gives way to it.
    """
    new = {"n_words", "n_removed", "kept_text"}
    base = docs.select([c for c in docs.columns if c not in new or c in (id_col, text_col)])
    spans = repeated_spans(base, id_col, text_col, window)
    some = span_filter(spans)
    may_have = F.pandas_udf(lambda hashes: pd.Series(some.passes(hashes.to_numpy().view(np.uint64))), "boolean")
    rows = base.select(F.struct("*").alias("row"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("oid"),
                       F.xxhash64(F.col(text_col)).alias("tkey")).select("*", _text_hash().alias("__hash"))
    marked = rows.where(may_have("__hash")).join(spans, ["oid", "tkey"], "left").select("row.*", F.col("spans").alias("__spans"))
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
                           T.StructField("kept_text", T.StringType())])
    return rows.select("row.*", "__hash").mapInArrow(without_any(text_col, some), schema).union(marked.mapInArrow(without_spans(text_col), schema))
