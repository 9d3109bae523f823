"""Token counts through a digest cache.

A text's count depends on its normalised content and on the tokenizer alone, so counts are stored under
(content digest, tokenizer digest).  A run joins its documents' digests with the stored ones, encodes each
distinct text that is missing once, and appends the new counts.  Normalisation here is only that a
null text is empty: anything more would change the counts.

The cache is a Parquet folder, partitioned by tokenizer digest; appending adds files and never
rewrites any.  A copied text, however often it occurs, is one digest: copies are dropped before the shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.llm.tables import _CLEANUP
from txnflow.llm.wordbytes import pieces

PIECE_BYTES = 4 << 20
CACHE_SCHEMA = "digest binary, n_bytes long, n_tokens long, tokenizer string"

_LOADED: dict[str, object] = {}


def load_counter(path: str):
    """A function from texts to their numbers of tokens: sentencepiece for .model, tokenizers for .json.

    Nothing is added to a text, and nothing cut or padded.
    """
    if path not in _LOADED:
        if path.endswith(".model"):
            import sentencepiece
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _LOADED[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1, add_bos=False, add_eos=False)]
        else:
            from tokenizers import Tokenizer
            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            _LOADED[path] = lambda texts: [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    return _LOADED[path]


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = load_counter(path)
        for piece in pieces(batches, "text", PIECE_BYTES):
            texts = piece.column(1).to_pylist()
            yield pa.record_batch([piece.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                                   pa.array(count(texts), pa.int64())], ["digest", "n_bytes", "n_tokens"])
    return run


def _digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def cached(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """The stored counts of one tokenizer version; none if the cache does not exist yet."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], CACHE_SCHEMA)
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == version)


def count_tokens(docs: DataFrame, tokenizer: str, cache: str, text_col: str = "text") -> DataFrame:
    """``docs`` with n_bytes (UTF-8) and n_tokens; counts that ``cache`` lacks are computed and appended to it.

    A null text counts as empty.  Equal texts share one entry.  All rows and columns of ``docs`` return; a column
    that has the name of a new one gives way.  A run that fails while appending leaves no partial entry, and two
    runs that append the same digest store equal counts, of which one is read.
    """
    spark = docs.sparkSession
    version = tokenizer_digest(tokenizer)
    known = cached(spark, cache, version).select("digest")
    texts = docs.select(_digest(text_col).alias("digest"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    misses = texts.groupBy("digest").agg(F.first("text").alias("text")).join(known, "digest", "left_anti")
    new = misses.mapInArrow(_encode(tokenizer), "digest binary, n_bytes long, n_tokens long").withColumn("tokenizer", F.lit(version))
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")          # the texts' shuffle files are not needed after the append
    try:
        new.write.mode("append").partitionBy("tokenizer").parquet(cache)
    finally:
        spark.conf.set(_CLEANUP, before)
    counts = cached(spark, cache, version).groupBy(F.col("digest").alias("__digest")) \
        .agg(F.first("n_bytes").alias("__n_bytes"), F.first("n_tokens").alias("__n_tokens"))
    own = [c for c in docs.columns if c not in ("n_bytes", "n_tokens")]
    # Joined on a second key too, so that the counts are dealt out anew: Spark splits the skewed partition of a
    # much copied text only between two plain exchanges, not where one side comes straight from a grouping.
    keys = ["__digest", "__prefix"]
    prefix = F.substring("__digest", 1, 4)
    return (docs.withColumn("__digest", _digest(text_col)).select(*own, "__digest", prefix.alias("__prefix"))
            .join(counts.withColumn("__prefix", prefix), keys)
            .select(*own, F.col("__n_bytes").alias("n_bytes"), F.col("__n_tokens").alias("n_tokens")))
