"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from condense.llm import classifier, decontaminate, jaccard, linedup, perplexity, pieces, pii, sharding, substring, suffixes

QUERIES = {
    "op1_multi_order_jaccard": jaccard.op1,
    "op2_sentencepiece_lattice": pieces.op2,
    "op3_kneser_ney_rules": perplexity.op3,
    "op4_ftrl_quality_classifier": classifier.op4,
    "op5_difference_cover_substrings": substring.op5,
    "op6_wu_manber_decontamination": decontaminate.op6,
    "op7_winnowing_line_dedup": linedup.op7,
    "op8_two_pass_shuffle": sharding.op8,
    "op9_suffix_array_dedup": suffixes.op9,
    "op10_information_theoretic_pii": pii.op10,
}

ORACLE_SQL = {
    "op1_multi_order_jaccard": jaccard.OP1_SQL,
    "op5_difference_cover_substrings": substring.OP5_SQL,
    "op6_wu_manber_decontamination": decontaminate.OP6_SQL,
    "op7_winnowing_line_dedup": linedup.OP7_SQL,
}
