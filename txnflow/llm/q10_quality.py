"""Query op10: quality of ``documents``, learned from ``labels``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnflow.llm.quality import learn, score_quality
from txnflow.llm.registry import register
from txnflow.llm.tables import read

THRESHOLD = 0.3


def held_out(id_col: str = "doc_id") -> Column:
    """A null id counts as the empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


@register("op10_quality")
def op10(spark, sf_dir):
    """Per document: doc_id, held_out, score, predicted."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    weights = learn(docs, read(spark, sf_dir, "labels"), ~held_out())
    return score_quality(docs, weights).select("doc_id", held_out().alias("held_out"), "score",
                                               (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
