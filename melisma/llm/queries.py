"""Queries of the training-data operators, and SQL for those that it can express."""

from __future__ import annotations

from . import bpeprefix, decontam, divergence, htmlwrap, impactsearch, langid, line_rules, merkle, ngramjoin, packing, quality_knn, sharding, suffixdedup

QUERIES = {
    "op1_merkle_fixity": merkle.op1_merkle_fixity,
    "op2_prefix_decontamination": decontam.op2_prefix_decontamination,
    "op3_feistel_shards": sharding.op3_feistel_shards,
    "op4_suffix_dedup": suffixdedup.op4_suffix_dedup,
    "op5_subword_language": langid.op5_subword_language,
    "op6_chosen_path_join": ngramjoin.op6_chosen_path_join,
    "op7_hierarchical_packing": packing.op7_hierarchical_packing,
    "op8_neighbour_quality": quality_knn.op8_neighbour_quality,
    "op9_wrapper_induction": htmlwrap.op9_wrapper_induction,
    "op10_line_first_rules": line_rules.op10_line_first_rules,
    "op11_impact_search": impactsearch.op11_impact_search,
    "op12_prefix_bpe": bpeprefix.op12_prefix_bpe,
    "op13_source_divergence": divergence.op13_source_divergence,
}
ORACLE: dict[str, str] = {"op1_merkle_fixity": merkle.ORACLE, "op10_line_first_rules": line_rules.ORACLE, "op11_impact_search": impactsearch.ORACLE, "op13_source_divergence": divergence.ORACLE}
