"""The queries of the operators and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from . import ann, chat, decontamination, katz, merkle, mixing, neardup, periodic, pieces, pii, quality, tokencount, toxicity

QUERIES = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_chat_format": chat.op2_chat_format,
    "op3_katz_scores": katz.op3_katz_scores,
    "op4_decontaminate": decontamination.op4_decontaminate,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_near_duplicates": neardup.op6_near_duplicates,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_nearest": ann.op8_nearest,
    "op9_mix_sources": mixing.op9_mix_sources,
    "op10_quality": quality.op10_quality,
    "op11_pieces": pieces.op11_pieces,
    "op12_manifest": merkle.op12_manifest,
    "op13_periodic_runs": periodic.op13_periodic_runs,
}

ORACLES = {
    "op2_chat_format": chat.OP2_SQL,
    "op9_mix_sources": mixing.OP9_SQL,
    "op12_manifest": merkle.OP12_SQL,
}
