"""The queries of this package and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from pathloom.llm import chat, decontam, embedding, html, langid, lloyd, minhash, mixing, negatives, pii, quality, sharding, toxicity

QUERIES = {
    "op1_ipf_mixing": mixing.query,
    "op2_chat_prefix_targets": chat.query,
    "op3_external_shuffle": sharding.query,
    "op4_positional_decontamination": decontam.query,
    "op5_line_crf_quality": quality.query,
    "op6_language_id": langid.query,
    "op7_toxicity": toxicity.query,
    "op8_superminhash_dedup": minhash.query,
    "op9_metric_range_join": embedding.query,
    "op10_html_blocks": html.query,
    "op11_disclosure_sanitisation": pii.query,
    "op12_hard_negatives": negatives.query,
    "op13_lloyd": lloyd.query,
}

ORACLES = {
    "op1_ipf_mixing": mixing.ORACLE,
    "op2_chat_prefix_targets": chat.ORACLE,
    "op4_positional_decontamination": decontam.ORACLE,
    "op8_superminhash_dedup": minhash.ORACLE,
    "op9_metric_range_join": embedding.ORACLE,
    "op12_hard_negatives": negatives.ORACLE,
    "op13_lloyd": lloyd.ORACLE,
}
