"""Registered queries of the subpackage and their DuckDB twins."""

from __future__ import annotations

from veilspan.llm import boundaries, hash_tree, jaccard_join, language_filters, line_crf, mixing, rule_ensemble, run_length_index, secret_forest, spelling, tree_scoring, weak_toxicity, winnowing

QUERIES = {
    "op1_secret_forest": secret_forest.op1_secret_forest,
    "op2_run_length_index": run_length_index.op2_run_length_index,
    "op3_line_crf": line_crf.op3_line_crf,
    "op4_winnowing": winnowing.op4_winnowing,
    "op5_weak_toxicity": weak_toxicity.op5_weak_toxicity,
    "op6_grouped_prefix": jaccard_join.op6_grouped_prefix,
    "op7_tree_scoring": tree_scoring.op7_tree_scoring,
    "op8_source_mix": mixing.op8_source_mix,
    "op9_language_filters": language_filters.op9_language_filters,
    "op10_hash_tree": hash_tree.op10_hash_tree,
    "op11_sorted_variants": spelling.op11_sorted_variants,
    "op12_boundary_set": boundaries.op12_boundary_set,
    "op13_rule_ensemble": rule_ensemble.op13_rule_ensemble,
}

SQL = {
    "op4_winnowing": winnowing.OP4_SQL,
    "op6_grouped_prefix": jaccard_join.OP6_SQL,
    "op8_source_mix": mixing.OP8_SQL,
    "op11_sorted_variants": spelling.OP11_SQL,
    "op12_boundary_set": boundaries.OP12_SQL,
}
