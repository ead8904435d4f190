"""Queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tremor.llm import decontaminate, html_extract, line_dedup, lm_score, merkle, mixing, near_dedup, prefix_trie, quality_model, quality_rules, secret_scan, token_output, toxicity

QUERIES = {
    "op1_quality_model": quality_model.op1_quality_model,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_lm_score": lm_score.op6_lm_score,
    "op7_mixing": mixing.op7_mixing,
    "op8_token_output": token_output.op8_token_output,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_secret_scan": secret_scan.op13_secret_scan,
}

ORACLES = {
    "op4_near_dedup": near_dedup.ORACLE,
    "op5_decontaminate": decontaminate.ORACLE,
    "op2_quality_rules": quality_rules.ORACLE,
    "op3_line_dedup": line_dedup.ORACLE,
    "op11_merkle_manifest": merkle.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
