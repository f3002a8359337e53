"""Queries of the training-data operators, and SQL with the same rows where there is any."""

from __future__ import annotations

from . import ann, html_extract, mixing, near_dedup, packing, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filters

QUERIES = {
    "op1_packing": packing.query,
    "op2_quality_classifier": quality_classifier.query,
    "op3_html_extraction": html_extract.query,
    "op4_nearest_neighbours": ann.query,
    "op5_quality_rules": quality_rules.query,
    "op6_suffix_dedup": suffix_dedup.query,
    "op7_token_counts": token_counts.query,
    "op8_url_filters": url_filters.query,
    "op9_near_dedup": near_dedup.query,
    "op10_mixing": mixing.query,
}

ORACLES: dict[str, str] = {
    "op8_url_filters": url_filters.ORACLE,
    "op9_near_dedup": near_dedup.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
