"""Registered queries of the text operators and their SQL oracles."""

from sitewise.llm import (
    decontamination, exact_search, fill_in_middle, language_id, line_dedup, minhash, packing, quality_classifier, quality_rules, sharding, substring_dedup,
    toxicity, whitening,
)

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_language_id": language_id.op3_language_id,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_benchmark_decontamination": decontamination.op5_benchmark_decontamination,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_sharding": sharding.op7_sharding,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_exact_top_k": exact_search.op13_exact_top_k,
}

ORACLES = {
    "op1_minhash_near_dedup": minhash.ORACLE_SQL,
    "op5_benchmark_decontamination": decontamination.ORACLE_SQL,
    "op6_quality_rules": quality_rules.ORACLE_SQL,
    "op10_quality_classifier": quality_classifier.ORACLE_SQL,
    "op11_fill_in_middle": fill_in_middle.ORACLE_SQL,
    "op13_exact_top_k": exact_search.ORACLE_SQL,
}
