"""The operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from evalmill.llm import decontam, divergence, media, mixing, near_dup, pieces, pii, ppm, quality, secrets, token_counts, toxicity, turn_trie

QUERIES = {
    "op1_lm_ppm": ppm.op1_lm_ppm,
    "op2_decontam": decontam.op2_decontam,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_pieces": pieces.op5_pieces,
    "op6_secrets": secrets.op6_secrets,
    "op7_quality": quality.op7_quality,
    "op8_pii": pii.op8_pii,
    "op9_media": media.op9_media,
    "op10_near_dup": near_dup.op10_near_dup,
    "op11_turn_trie": turn_trie.op11_turn_trie,
    "op12_divergence": divergence.op12_divergence,
    "op13_mixing": mixing.op13_mixing,
}

ORACLES = {
    "op8_pii": pii.ORACLE_SQL,
    "op11_turn_trie": turn_trie.ORACLE_SQL,
    "op12_divergence": divergence.ORACLE_SQL,
}
