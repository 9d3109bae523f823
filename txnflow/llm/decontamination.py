"""Benchmark decontamination by a prefix-filtered join on rare shingles.

A benchmark item becomes windows of ``window`` consecutive words (an item of fewer words: one window).  A
window occurs in a document only if each of its shingles does, so looking up one necessary shingle -- the
prefix of the window's shingles in order of rarity -- finds every occurrence.  Rarity is counted over all
documents.  The offset of the rare shingle in its window bounds where the window must begin and end in the
document, and the words in between are then compared one by one.

Documents are read twice, for the counts and for the lookups, and send only places whose shingle passes a
filter of fixed size.  Counts are summed per batch before they are sent.  The join of places and
windows is left to Spark: it broadcasts the windows below the session's threshold, else both sides are shuffled
and skewed shingles split.  Nothing but the fixed-size filter passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnflow.llm import wordbytes
from txnflow.llm.tables import discard, listed, written

SHINGLE = 3
PIECE_BYTES = 1 << 20
FILTER_BITS = 23               # log2 of the filter's places: 1 MB
LAST = (1 << 63) - 1


def _tokens(hashes: np.ndarray, n: int) -> np.ndarray:
    """64-bit tokens of the ``n``-word shingles; another ``n`` gives other tokens."""
    return wordbytes.mix(wordbytes.grams(hashes, n) + np.uint64(n))


def _windows(window: int):
    """(item_id, text) to (window, words, tokens): distinct windows of a batch with the tokens of their shingles.

    A window's words are lower-case and joined by one space.  Items of fewer than three words have shorter
    shingles, tokens of all of their words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            words = wordbytes.scan(piece.column(1), wordbytes.ALNUM).tight()
            hashes = words.hashes()
            ids, texts, sizes, tokens = [], [], [], []
            for i, (lo, n) in enumerate(zip(words.first.tolist(), words.counts().tolist())):
                long = min(n, window)
                for at in range(lo, lo + n - long + 1 if n else lo):
                    ids.append(i)
                    texts.append(words.slice(at, at + long).decode())
                    sizes.append(long)
                    tokens.append(_tokens(hashes[at:at + long], min(SHINGLE, long)).view(np.int64))
            yield pa.record_batch([piece.column(0).take(pa.array(ids, pa.int64())), pa.array(texts, pa.string()),
                                   pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))],
                                  ["item_id", "words", "size", "tokens"])
    return run


def _filter(tokens: DataFrame) -> np.ndarray:
    """A bit for each token modulo the filter's size: at most 2^FILTER_BITS bits, whatever the number of tokens."""
    place = F.pmod(F.col("token"), F.lit(1 << FILTER_BITS))
    rows = tokens.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, cast(pmod(token, {1 << FILTER_BITS}) & 63 as int))").alias("bit")) \
        .groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    bits[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def _passing(hashes: np.ndarray, words: wordbytes.Words, n: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and tokens of the ``n``-word shingles that pass the filter, none of them beyond its text."""
    tokens = _tokens(hashes, n)
    at = np.flatnonzero(some[(tokens & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)])
    ends = words.first[np.searchsorted(words.first, at, "right")]
    at = at[at + n <= ends]
    return at, tokens[at].view(np.int64)


def _counts(lengths: list[int], some: Broadcast):
    """Texts to (token, n): how often tokens that pass the filter occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            words = wordbytes.scan(piece.column(piece.num_columns - 1), wordbytes.ALNUM)
            hashes = words.hashes()
            found = [_passing(hashes, words, n, some.value)[1] for n in lengths]
            tokens, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.record_batch([tokens, n], ["token", "n"])
    return run


def _places(lengths: list[int], some: Broadcast, window: int):
    """(oid, tkey, text) to (oid, tkey, token, place, before, words): rare shingles with the words around them.

    ``words`` joins the ``before`` words before the shingle and those after it that a window may need.
    A document also gives one row with a null token and its number of words as place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in wordbytes.pieces(batches, "text", PIECE_BYTES):
            words = wordbytes.scan(piece.column(2), wordbytes.ALNUM).tight()
            hashes = words.hashes()
            found = [_passing(hashes, words, n, some.value) for n in lengths]
            at, token = (np.concatenate(c) for c in zip(*found))
            owner = np.searchsorted(words.first, at, "right") - 1
            lo = np.maximum(at - window + 1, words.first[owner])
            hi = np.minimum(at + window, words.first[owner + 1])
            data = words.data.tobytes()
            around = [data[a:b].decode() for a, b in zip(words.start[lo].tolist(), words.end[hi - 1].tolist())]
            docs = np.arange(piece.num_rows)
            rows = pa.array(np.concatenate([docs, owner]))
            none = piece.num_rows
            yield pa.record_batch([
                piece.column(0).take(rows), piece.column(1).take(rows),
                pa.array(np.concatenate([docs, token]), pa.int64(), mask=np.arange(len(rows)) < none),
                pa.array(np.concatenate([words.counts(), at - words.first[owner]]), pa.int64()),
                pa.array(np.concatenate([docs * 0, at - lo]), pa.int32()),
                pa.array([None] * none + around, pa.string())],
                ["oid", "tkey", "token", "place", "before", "words"])
    return run


def _covered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct places where windows begin, by their size, to the number of words that any of them covers."""
    for batch in batches:
        out = []
        for starts in batch.column(2).to_pylist():
            n, end = 0, -1
            for lo, hi in sorted((s["lo"], s["hi"]) for s in starts or ()):
                n += max(0, hi - max(lo, end))
                end = max(end, hi)
            out.append(n)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.int64())], ["oid", "tkey", "n_hit"])


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       item_col: str = "item_id", item_text: str = "text", window: int = 10) -> DataFrame:
    """One row for each row of ``docs``: oid, tkey, n_words, n_hit (long), items (sorted array of strings).

    oid is the id as a long (null: the largest long), tkey a hash of the text.  Words are lower-cased (A-Z)
    ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; null and blank texts have none.  Items without words, and null items, have no
    window.  Equal rows get equal answers.  A null item_id finds words, but is not listed.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item_id"), F.col(item_text).alias("text"))
    windows = written(items.mapInArrow(_windows(window), "item_id string, words string, size int, tokens array<long>").distinct(),
                      "windows")
    tokens = windows.select("size", F.posexplode("tokens").alias("offset", "token"))
    lengths = sorted(min(SHINGLE, r[0]) for r in windows.select("size").distinct().collect()) or [SHINGLE]   # at most window sizes
    lengths = sorted(set(lengths))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("oid"),
                        F.xxhash64(F.col(text_col)).alias("tkey"), F.col(text_col).alias("text"))

    every = spark.sparkContext.broadcast(_filter(tokens))
    counts = written(texts.select("text").mapInArrow(_counts(lengths, every), "token long, n long")
                     .groupBy("token").agg(F.sum("n").alias("n")), "rarity")
    # The necessary prefix: of a window's shingles in order of rarity, the first.
    rank = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token", "offset")
    prefix = written(windows.select("words", "size", F.posexplode("tokens").alias("offset", "token")).distinct()
                     .join(counts, "token", "left").groupBy("words", "size").agg(F.min(rank).alias("r"))
                     .select("words", "size", "r.token", "r.offset", "r.n").where("n > 0"), "prefix")
    rare = spark.sparkContext.broadcast(_filter(prefix))
    places = written(texts.mapInArrow(_places(lengths, rare, window),
                                      "oid long, tkey long, token long, place long, before int, words string"), "places")
    held = F.split("words", " ")
    found = (places.where("token is not null").withColumnRenamed("words", "around")
             .join(prefix.withColumnRenamed("words", "wanted"), "token")
             .where("before >= offset")                                              # positional bound on the left
             .withColumn("part", F.expr("slice(split(around, ' '), before - offset + 1, size)"))
             .where("size(part) = size")                                             # length bound on the right
             .where(F.concat_ws(" ", "part") == F.col("wanted"))
             .select("oid", "tkey", (F.col("place") - F.col("offset")).alias("lo"), "size", "wanted"))
    found = written(found.distinct(), "occurrences")
    starts = found.groupBy("oid", "tkey").agg(F.collect_set(F.struct("lo", (F.col("lo") + F.col("size")).alias("hi"))).alias("starts"))
    hits = starts.mapInArrow(_covered, "oid long, tkey long, n_hit long")
    of = (found.select("oid", "tkey", "wanted").distinct()
          .join(windows.select(F.col("words").alias("wanted"), "item_id").distinct(), "wanted")
          .groupBy("oid", "tkey").agg(F.sort_array(F.collect_set("item_id")).alias("items")))
    answers = hits.join(of, ["oid", "tkey"])
    return (places.where("token is null").select("oid", "tkey", F.col("place").alias("n_words"))
            .join(answers, ["oid", "tkey"], "left")
            .select("oid", "tkey", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no window of ``benchmark`` occurs."""
    with listed() as used:
        hit = find_contamination(docs, benchmark, id_col, text_col, **options).where("n_hit > 0").select("oid", "tkey").distinct()
        hit = written(hit.toDF("__oid", "__tkey"), "contaminated")
    discard(*[t for t in used if t is not hit])
    return docs.join(hit, (F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)) == F.col("__oid"))
                     & (F.xxhash64(F.col(text_col)) == F.col("__tkey")), "left_anti")
