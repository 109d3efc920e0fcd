"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from . import (
    ann_forest, html_extraction, importance_resampling, language_id, line_dedup, mixing, ngram_join, packing, quality_classifier, quality_rules, source_audit,
    substring_dedup, toxicity,
)

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_packing": packing.op3_packing,
    "op4_quality_classifier": quality_classifier.op4_quality_classifier,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_mixing": mixing.op6_mixing,
    "op7_html_extraction": html_extraction.op7_html_extraction,
    "op8_ann_forest": ann_forest.op8_ann_forest,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_language_id": language_id.op10_language_id,
    "op11_substring_dedup": substring_dedup.op11_substring_dedup,
    "op12_source_audit": source_audit.op12_source_audit,
    "op13_importance_resampling": importance_resampling.op13_importance_resampling,
}

ORACLE_SQL = {
    "op2_line_dedup": line_dedup.OP2_SQL, "op11_substring_dedup": substring_dedup.OP11_SQL, "op12_source_audit": source_audit.OP12_SQL,
    "op13_importance_resampling": importance_resampling.OP13_SQL,
}
