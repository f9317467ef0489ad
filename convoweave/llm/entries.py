"""The subpackage's queries and their SQL twins, one for each operator."""

from __future__ import annotations

from convoweave.llm import decontamination, exact_dedup, fill_in_middle, mixing, ngram_join, quality_neighbours, quality_rules, repeats, sharding, toxicity, training_order, url_filters, whitening

MODULES = {
    "op1_quality_rules": quality_rules,
    "op2_toxicity": toxicity,
    "op3_ngram_join": ngram_join,
    "op4_mixing": mixing,
    "op5_quality_classifier": quality_neighbours,
    "op6_repeated_substrings": repeats,
    "op7_url_filters": url_filters,
    "op8_sharding": sharding,
    "op9_decontamination": decontamination,
    "op10_training_order": training_order,
    "op11_fill_in_middle": fill_in_middle,
    "op12_exact_dedup": exact_dedup,
    "op13_whitening": whitening,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict:
    return {name: module.SQL for name, module in MODULES.items() if hasattr(module, "SQL")}
