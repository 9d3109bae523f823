"""Query op11: two public tokenizers aligned over ``documents``."""

from __future__ import annotations

import public_tokenizers
from txnflow.llm.alignment import align_tokenizers
from txnflow.llm.registry import register
from txnflow.llm.tables import read


@register("op11_alignment")
def op11(spark, sf_dir):
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    aligned = align_tokenizers(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"),
                               public_tokenizers.path("piece_bpe_32k.model"), digests=True)
    return aligned.withColumnRenamed("groups", "groups_sha256")
