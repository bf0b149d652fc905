"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from . import chat, decontamination, exact_dedup, html_extraction, jaccard_join, lm_scoring, merkle, packing, pii, quality, secrets, toxicity, whitening

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_lm_scoring": lm_scoring.op2_lm_scoring,
    "op3_decontamination": decontamination.op3_decontamination,
    "op4_pii": pii.op4_pii,
    "op5_chat_format": chat.op5_chat_format,
    "op6_secrets": secrets.op6_secrets,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_packing": packing.op8_packing,
    "op9_html_extraction": html_extraction.op9_html_extraction,
    "op10_quality_classifier": quality.op10_quality_classifier,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_embedding_whitening": whitening.op12_embedding_whitening,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.OP1_SQL,
    "op3_decontamination": decontamination.OP3_SQL,
    "op5_chat_format": chat.OP5_SQL,
    "op7_jaccard_join": jaccard_join.OP7_SQL,
    "op13_merkle_manifest": merkle.OP13_SQL,
}
