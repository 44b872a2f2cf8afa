"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import edit_match, fill_middle, iblt, jaccard_join, language_id, licenses, mixing, secrets, substring_dedup, suffix_tree, token_shards, url_filter

QUERIES = {
    "op1_relative_lz": substring_dedup.op1,
    "op2_owner_frequency": secrets.op2,
    "op3_segmented_hosts": url_filter.op3,
    "op4_wavelet_shards": token_shards.op4,
    "op5_output_codes": language_id.op5,
    "op6_bayesian_jaccard": jaccard_join.op6,
    "op7_positional_rare_words": licenses.op7,
    "op8_pigeonhole_edits": edit_match.op8,
    "op9_invertible_sketch": iblt.op9,
    "op10_curriculum_mix": mixing.op10,
    "op11_two_pass_fim": fill_middle.op11,
    "op12_suffix_tree": suffix_tree.op12,
}

SQL = {
    "op1_relative_lz": substring_dedup.OP1_SQL,
    "op2_owner_frequency": secrets.OP2_SQL,
    "op7_positional_rare_words": licenses.OP7_SQL,
    "op10_curriculum_mix": mixing.OP10_SQL,
    "op11_two_pass_fim": fill_middle.OP11_SQL,
    "op12_suffix_tree": suffix_tree.OP12_SQL,
}
