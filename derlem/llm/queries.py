"""Queries of the corpus operators and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from . import decontaminate, divergence, edit_counts, lloyd, packing, pii, quality, secrets, simhash, substring_dedup, toxicity, url_filter, va_file
from .sql import ORACLE

QUERIES = {
    "op10_edit_counts": edit_counts.op10_edit_counts,
    "op8_secret_ownership": secrets.op8_secret_ownership,
    "op7_quality_divergence": quality.op7_quality_divergence,
    "op2_pii_bootstrap": pii.op2_pii_bootstrap,
    "op9_toxicity": toxicity.op9_toxicity,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op4_decontaminate": decontaminate.op4_decontaminate,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op6_simhash_groups": simhash.op6_simhash_groups,
    "op1_url_reputation": url_filter.op1_url_reputation,
    "op11_va_topk": va_file.op11_va_topk,
    "op12_weighted_lloyd": lloyd.op12_weighted_lloyd,
    "op13_source_divergence": divergence.op13_source_divergence,
}

__all__ = ["ORACLE", "QUERIES"]
