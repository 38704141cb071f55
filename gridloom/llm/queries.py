"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib

#: query -> (module of this subpackage, function)
MODULES = {
    "op4_sentencepiece": ("sentencepiece_sa", "op4_sentencepiece"),
    "op6_vector_join": ("vector_join", "op6_vector_join"),
    "op9_minhash": ("minhash_join", "op9_minhash"),
    "op10_license_scan": ("license_rules", "op10_license_scan"),
    "op2_mixing": ("mixing", "op2_mixing"),
    "op3_pii": ("pii", "op3_pii"),
    "op8_langid": ("langid", "op8_langid"),
    "op7_media_avi": ("media_avi", "op7_media_avi"),
    "op1_warc": ("warc", "op1_warc"),
    "op5_token_files": ("tokenfiles", "op5_token_files"),
    "op11_turn_repair": ("turn_repair", "op11_turn_repair"),
    "op12_token_counts": ("token_counts", "op12_token_counts"),
    "op13_source_divergence": ("divergence", "op13_source_divergence"),
}


def queries() -> dict:
    return {name: getattr(importlib.import_module(f"gridloom.llm.{module}"), function) for name, (module, function) in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    from gridloom.llm import divergence, minhash_join, turn_repair, vector_join, warc

    return {"op1_warc": warc.OP1_SQL, "op6_vector_join": vector_join.OP6_SQL, "op9_minhash": minhash_join.OP9_SQL, "op11_turn_repair": turn_repair.OP11_SQL, "op13_source_divergence": divergence.OP13_SQL}
