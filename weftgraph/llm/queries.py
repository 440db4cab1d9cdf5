"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from weftgraph.llm import decontaminate, html_main, licenses, mixing, ngram_join, quality, substring_dedup, surrogates, token_counts, training_order

QUERIES = {
    "op1_surrogates": surrogates.op1_surrogates,
    "op2_ngram_join": ngram_join.op2_ngram_join,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_extract_main": html_main.op4_extract_main,
    "op5_training_order": training_order.op5_training_order,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_mix": mixing.op8_mix,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_license_scan": licenses.op10_license_scan,
}

ORACLE_SQL = {
    "op2_ngram_join": ngram_join.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op7_substring_dedup": substring_dedup.SQL,
    "op10_license_scan": licenses.SQL,
}
