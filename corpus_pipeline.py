"""The corpus pipeline: from ``documents`` to token ids.

Each stage calls one operator of ``txnflow.llm`` on all that its predecessor kept, is written as Parquet in the
shared folder and read again as the next one's input, which is deleted when the next one's output is written.  All but
the last return the columns of ``documents``.

Every stage takes null ids and texts, empty texts, repeated rows, empty tables and further columns; what it does with
them is what its operator documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from txnflow.llm import bpe, decontamination, near_dedup, quality, substring_dedup
from txnflow.llm.registry import prepare
from txnflow.llm.tables import discard, listed, read, written

QUALITY_THRESHOLD = 0.3
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
REPEATED_WORDS = 20
BENCHMARK_WORDS = 10
VOCABULARY = "word_bpe_49k.json"


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn quality from all labelled documents and keep those with a score of at least the threshold."""
    prepare(spark)
    weights = quality.learn(docs, read(spark, sf_dir, "labels"), F.lit(True))
    scored = quality.score_quality(docs.withColumnRenamed("score", "__score"), weights)
    return scored.where(F.col("score") >= QUALITY_THRESHOLD).drop("score").withColumnRenamed("__score", "score").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each near-duplicate group."""
    prepare(spark)
    return near_dedup.drop_near_duplicates(docs, shingle=SHINGLE_WORDS, percent=SIMILAR_PERCENT)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that also stand earlier; a text without any stays as it is, one of nothing else goes."""
    prepare(spark)
    own = {c: f"__{c}" if c in ("n_words", "n_removed", "kept_text") else c for c in docs.columns}
    cut = substring_dedup.dedup_substrings(docs.withColumnsRenamed(own), window=REPEATED_WORDS)
    new = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in own:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return cut.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))) \
        .select(*[new.get(c, F.col(name)).alias(c) for c, name in own.items()])


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    prepare(spark)
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), window=BENCHMARK_WORDS)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, token_ids and the ids decoded again."""
    prepare(spark)
    encoded = bpe.encode_documents(docs, public_tokenizers.path(VOCABULARY))
    return encoded.select("doc_id", "lang", "source", "n_tokens", "token_ids", "decoded")


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("bpe_encoding", token_ids),
]

#: A trained classifier and BPE can't be written in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, used = read(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with listed() as made:
            docs = written(stage(spark, docs, sf_dir), name)
        discard(*used, *[t for t in made if t is not docs])
        used = [docs]
    return docs
