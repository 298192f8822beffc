"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from graphloom.llm import chroma, line_dedup, minhash, mixing_lm, mixture, pieces, quality, spotsigs, substring, token_counts


def queries() -> dict:
    return {
        "op1_chroma_fingerprints": chroma.op1,
        "op2_spotsigs_fingerprints": spotsigs.op2,
        "op3_mix_sources": mixture.op3,
        "op4_quality_classifier": quality.op4,
        "op5_line_dedup": line_dedup.op5,
        "op6_mixing_lm": mixing_lm.op6,
        "op7_minhash_near_dedup": minhash.op7,
        "op8_substring_dedup": substring.op8,
        "op9_sentencepiece": pieces.op9,
        "op10_token_counts": token_counts.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_mix_sources": mixture.OP3_SQL, "op5_line_dedup": line_dedup.OP5_SQL, "op7_minhash_near_dedup": minhash.OP7_SQL, "op8_substring_dedup": substring.OP8_SQL}
