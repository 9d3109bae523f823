"""Query op7: ``documents`` as ids of a public vocabulary file, and back."""

from __future__ import annotations

import public_tokenizers
from txnflow.llm.bpe import encode_digests
from txnflow.llm.registry import register
from txnflow.llm.tables import read


@register("op7_bpe")
def op7(spark, sf_dir):
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")
