"""Query op1: tokens of ``documents`` under a public sentencepiece model."""

from __future__ import annotations

from pyspark.sql import functions as F

import public_tokenizers
from txnflow.llm.registry import register
from txnflow.llm.tables import read, scratch_path
from txnflow.llm.token_counts import count_tokens

LIMIT = 4096


@register("op1_token_counts")
def op1(spark, sf_dir):
    """Per document: doc_id, n_bytes, n_tokens, over_limit.  Starts from an empty cache."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    counts = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), scratch_path(spark, "token-cache"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
