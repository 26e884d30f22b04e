"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import bpe_codec, exact_dedup, hard_negatives, jaccard, main_text, media, packing, pii, sessions, substring_dedup, token_counts, toxicity, warc

QUERIES = {
    "op5_toxicity": toxicity.op5_toxicity,
    "op1_warc": warc.op1_warc,
    "op8_media_columns": media.op8_media_columns,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op10_bpe_codec": bpe_codec.op10_bpe_codec,
    "op2_token_counts": token_counts.op2_token_counts,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op6_pii_spans": pii.op6_pii_spans,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_late_sessions": sessions.op12_late_sessions,
    "op13_main_text": main_text.op13_main_text,
    "pii_span_scores": pii.pii_span_scores,
}
ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op7_ngram_jaccard": jaccard.OP7_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op6_pii_spans": pii.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_late_sessions": sessions.OP12_SQL,
}
