"""The operators as registered queries, and SQL for those that it can express."""

from __future__ import annotations

from complaintflow.llm import (
    classifier, decontamination, html_text, mixing, periodic_runs, pii, prefix_trie, projection_forest, quality_rules, sentence_dedup, simhash,
    suffix_dedup, tool_calls)

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.query,
    "op2_pseudonyms": pii.query,
    "op3_tool_calls": tool_calls.query,
    "op4_main_text": html_text.query,
    "op5_quality_score": classifier.query,
    "op6_fair_mix": mixing.query,
    "op7_benchmark_leaks": decontamination.query,
    "op8_robust_outliers": quality_rules.query,
    "op9_simhash": simhash.query,
    "op10_sentence_spans": sentence_dedup.query,
    "op11_projection_forest": projection_forest.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLES = {
    "op1_suffix_dedup": suffix_dedup.SQL,
    "op6_fair_mix": mixing.sql(),
    "op12_prefix_trie": prefix_trie.SQL,
}
