"""Query op6: languages of ``documents``, learned from three quarters of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from txnflow.llm.language_id import identify_languages, learn_profiles
from txnflow.llm.registry import register
from txnflow.llm.tables import read


@register("op6_language_id")
def op6(spark, sf_dir):
    """Per document: doc_id, held_out, lang_pred, score.  A null doc_id counts as the empty text."""
    remainder = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder == 2).alias("held_out"))
    profiles = learn_profiles(docs.where("not held_out").select("text", "lang"))
    return identify_languages(docs.select("doc_id", "text", "held_out"), profiles).select("doc_id", "held_out", "lang_pred", "score")
