"""Queries of the corpus operators, and their SQL where DuckDB can express it."""

from __future__ import annotations

from . import decontaminate, langid, line_dedup, minhash_dedup, oracles, packing, quality_classifier, quality_rules, secrets, substring_dedup, token_counts

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_minhash_dedup": minhash_dedup.op3_minhash_dedup,
    "op4_packing": packing.op4_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_quality_classifier": quality_classifier.op8_quality_classifier,
    "op9_langid": langid.op9_langid,
    "op10_secrets": secrets.op10_secrets,
}

ORACLES = {"op2_substring_dedup": oracles.OP2, "op5_quality_rules": oracles.OP5, "op7_decontaminate": oracles.OP7}
