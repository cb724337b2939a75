"""The queries of this package by name, and their SQL where SQL can express them."""

from __future__ import annotations

from riskmart.llm import (
    conversations,
    decontamination,
    hard_negatives,
    html_text,
    line_dedup,
    mixing,
    near_dedup,
    pii,
    quality_classifier,
    quality_rules,
    secret_scan,
    substring_dedup,
    toxicity,
)

_MODULES = {
    "op1_line_dedup": line_dedup,
    "op2_substring_dedup": substring_dedup,
    "op3_html_extraction": html_text,
    "op4_decontamination": decontamination,
    "op5_minhash_near_dedup": near_dedup,
    "op6_mixing": mixing,
    "op7_toxicity": toxicity,
    "op8_quality_classifier": quality_classifier,
    "op9_quality_rules": quality_rules,
    "op10_pii": pii,
    "op11_hard_negatives": hard_negatives,
    "op12_secret_scan": secret_scan,
    "op13_conversation_repair": conversations,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
