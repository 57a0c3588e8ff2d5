"""The operators' queries, and their SQL where SQL can express them."""

from . import decontamination, language_model, line_dedup, mixing, near_duplicates, quality_classifier, quality_rules, sharding, toxicity, url_filters

QUERIES = {
    f.__name__: f
    for f in (
        quality_rules.op1_risk_controlled_rules,
        toxicity.op2_nnpu_toxicity,
        decontamination.op3_benchmark_containment,
        sharding.op4_kd_tree_shards,
        mixing.op5_capped_water_filling,
        language_model.op6_backoff_automaton,
        url_filters.op7_nested_url_rules,
        line_dedup.op8_shared_lines,
        near_duplicates.op9_min_max_near_duplicates,
        quality_classifier.op10_random_indexing_quality,
    )
}
ORACLE_SQL = {
    "op3_benchmark_containment": decontamination.ORACLE,
    "op5_capped_water_filling": mixing.ORACLE,
    "op7_nested_url_rules": url_filters.ORACLE,
    "op8_shared_lines": line_dedup.ORACLE,
}
