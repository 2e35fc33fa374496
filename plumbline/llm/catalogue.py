"""Queries of the training-data operators and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, exact_dedup, language, ngram_join, packing, personal_data, secret_scan, site_quality, token_counts, warc

_QUERIES = {"op4_ngram_join": ngram_join, "op3_decontamination": decontamination, "op9_site_quality": site_quality, "op8_personal_data": personal_data, "op2_token_counts": token_counts, "op6_secret_scan": secret_scan, "op5_language": language, "op1_warc": warc, "op7_exact_dedup": exact_dedup, "op10_packing": packing}


def queries() -> dict:
    return {name: module.query for name, module in sorted(_QUERIES.items())}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _QUERIES.items() if getattr(module, "SQL", None)}
