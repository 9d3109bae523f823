"""Import every query module so that all queries are registered."""

from txnflow.llm import (q01_token_counts, q02_substring_dedup, q03_url_rules, q04_decontamination,  # noqa: F401
                         q05_license_scan, q06_language_id, q07_bpe, q08_near_dedup, q09_topk_search,
                         q10_quality, q11_alignment, q12_filter_audit, q13_jaccard_join)
from txnflow.llm.registry import QUERIES  # noqa: F401
