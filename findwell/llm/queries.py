"""Queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from importlib import import_module

#: query name -> module that holds it
MODULES = {
    "op1_language_id": "language_id",
    "op10_toxicity": "toxicity",
    "op8_quality_classifier": "quality",
    "op2_token_counts": "token_counts",
    "op3_lm_scoring": "lm_scoring",
    "op4_benchmark_decontamination": "decontamination",
    "op5_audio_fingerprints": "audio_fingerprint",
    "op6_suffix_array_dedup": "suffix_dedup",
    "op7_source_mixing": "mixing",
    "op9_simhash_near_dedup": "simhash",
}

QUERIES = {name: getattr(import_module(f"findwell.llm.{module}"), name) for name, module in MODULES.items()}

ORACLE_SQL: dict[str, str] = {name: import_module(f"findwell.llm.{MODULES[name]}").ORACLE_SQL for name in ("op4_benchmark_decontamination", "op6_suffix_array_dedup", "op7_source_mixing")}
