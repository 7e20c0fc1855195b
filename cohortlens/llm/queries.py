"""Registered queries of the operators, and their DuckDB SQL where SQL can express them.

None for the others: sharding (CRC-32), nearest neighbours, toxicity, SimHash, token counts, personal data,
repeated passages (too slow in SQL on whole tables) and SentencePiece. Tests hold these against brute force.
"""

from __future__ import annotations

from cohortlens.llm import (
    exact_dedup,
    hard_negatives,
    mixing,
    nearest,
    page_text,
    periodic_runs,
    personal_data,
    pipeline,
    sentencepieces,
    sharding,
    simhash_dedup,
    substring_dedup,
    token_counts,
    toxicity,
)

QUERIES = {
    "op1_sharding": sharding.query,
    "op2_nearest_neighbours": nearest.query,
    "op3_exact_dedup": exact_dedup.query,
    "op4_toxicity": toxicity.query,
    "op5_simhash_dedup": simhash_dedup.query,
    "op6_mixing": mixing.query,
    "op7_token_counts": token_counts.query,
    "op8_personal_data": personal_data.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_sentencepiece": sentencepieces.query,
    "op11_periodic_runs": periodic_runs.query,
    "op12_page_text": page_text.query,
    "op13_hard_negatives": hard_negatives.query,
    "pipeline": pipeline.run,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op12_page_text": page_text.query,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
