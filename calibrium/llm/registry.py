"""The operators' queries and their SQL, as `__spark_entry__.py` adds them."""

from __future__ import annotations

from importlib import import_module

#: Query and module of each operator.
QUERIES = {
    "op1_best_fit_packing": "packing",
    "op7_minhash_near_dedup": "neardup",
    "op9_line_run_dedup": "linededup",
    "op6_quality_decision_list": "quality",
    "op10_benchmark_decontamination": "decontam",
    "op2_url_filter": "urls",
    "op4_counterfactual_toxicity": "toxicity",
    "op8_site_style_tree": "sitetree",
    "op5_license_signatures": "licenses",
    "op3_rans_token_files": "rans",
    "op11_importance_resampling": "resample",
    "op12_information_sanitisation": "pii",
    "op13_conversation_prefix_trie": "prefixtrie",
}


def queries() -> dict:
    return {name: getattr(import_module(f"calibrium.llm.{module}"), name) for name, module in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"calibrium.llm.{module}"), "ORACLE_SQL", None) for name, module in QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
