"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from corrgraph.llm import exact_dedup, language_id, mixing, ngram_join, quality_rules, secret_scan, sentencepiece_scan, substring_dedup, toxicity, wavelet


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_sentencepiece": sentencepiece_scan.op3_sentencepiece,
        "op4_token_output": wavelet.op4_token_output,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_secret_scan": secret_scan.op7_secret_scan,
        "op8_mixing": mixing.op8_mixing,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_language_id": language_id.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.OP1_SQL,
        "op5_ngram_join": ngram_join.OP5_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
    }
