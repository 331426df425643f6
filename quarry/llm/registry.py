"""The subpackage's queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from importlib import import_module

#: Query name and the module that has its ``query`` and, where SQL can express it, ``SQL``.
MODULES = {
    "op1_topk_search": "topk_search",
    "op2_byte_bpe": "bpe",
    "op4_token_counts": "token_counts",
    "op7_wavelet_tokens": "wavelet",
    "op9_toxicity": "toxicity",
    "op10_decontamination": "decontam",
    "op6_minhash_dedup": "minhash",
    "op8_suffix_dedup": "suffix_dedup",
    "op3_lm_scoring": "katz",
    "op5_perspective_rotation": "chat_format",
    "op11_quality_rules": "quality_rules",
    "op12_vector_codes": "vector_codes",
    "op13_feature_history": "feature_history",
}


def queries() -> dict:
    return {name: import_module(f"quarry.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"quarry.llm.{module}"), "SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
