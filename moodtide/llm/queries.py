"""The queries of this subpackage by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from . import audit, centroids, lines, quality, urls
from .embeddings import op8_embedding_near_dedup
from .mixing import op9_mixing_sources
from .packing import op2_best_fit_packing
from .pii import op12_pii
from .simhash import op3_simhash_near_dedup
from .substrings import op1_substring_dedup
from .tokens import op6_token_counts
from .toxicity import op4_toxicity

QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_url_filters": urls.op5_url_filters,
    "op6_token_counts": op6_token_counts,
    "op7_line_dedup": lines.op7_line_dedup,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_centroid_clustering": centroids.op11_centroid_clustering,
    "op12_pii": op12_pii,
    "op13_filter_audit": audit.op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op5_url_filters": urls.ORACLE,
    "op7_line_dedup": lines.ORACLE,
    "op10_quality_rules": quality.ORACLE,
    "op11_centroid_clustering": centroids.ORACLE,
    "op13_filter_audit": audit.ORACLE,
}
