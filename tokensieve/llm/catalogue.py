"""The corpus queries and their SQL twins."""

from __future__ import annotations

from tokensieve.llm import exact_dedup, language, mixing, near_dedup, passage_dedup, personal, quality, substring_dedup, subword, vectors


def queries() -> dict:
    return {
        "op1_near_vectors": vectors.op1_near_vectors,
        "op2_near_dedup": near_dedup.op2_near_dedup,
        "op3_passage_dedup": passage_dedup.op3_passage_dedup,
        "op4_quality": quality.op4_quality,
        "op5_language_id": language.op5_language_id,
        "op6_mix_sources": mixing.op6_mix_sources,
        "op7_substring_dedup": substring_dedup.op7_substring_dedup,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_subword_dropout": subword.op9_subword_dropout,
        "op10_personal_data": personal.op10_personal_data,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_mix_sources": mixing.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
    }
