"""Queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import ann_search, bpe, decontaminate, language_model, near_dedup, secrets_scan, substring_dedup, token_output, toxicity, url_filter

QUERIES = {
    "op1_token_output": token_output.query,
    "op2_lm_scoring": language_model.query,
    "op3_bpe": bpe.query,
    "op4_benchmark_decontamination": decontaminate.query,
    "op5_url_filters": url_filter.query,
    "op6_ann_search": ann_search.query,
    "op7_substring_dedup": substring_dedup.query,
    "op8_secret_scans": secrets_scan.query,
    "op9_minhash_near_dedup": near_dedup.query,
    "op10_toxicity": toxicity.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op4_benchmark_decontamination": decontaminate.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op7_substring_dedup": substring_dedup.ORACLE,
    "op9_minhash_near_dedup": near_dedup.ORACLE,
}


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
