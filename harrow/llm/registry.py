"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from . import decontaminate, html_text, jaccard_join, lexical, lm_score, pii, piece_lattice, quality, source_audit, suffix_dedup, token_counts, toxicity, warc

QUERIES = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_sentencepiece": piece_lattice.op2_sentencepiece,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_pii": pii.op8_pii,
    "op9_warc": warc.op9_warc,
    "op10_html_text": html_text.op10_html_text,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_source_audit": source_audit.op13_source_audit,
}

ORACLES = {
    "op3_suffix_dedup": suffix_dedup.OP3_SQL,
    "op4_quality_rules": quality.OP4_SQL,
    "op5_jaccard_join": jaccard_join.OP5_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
    "op9_warc": warc.OP9_SQL,
    "op10_html_text": html_text.OP10_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
    "op13_source_audit": source_audit.OP13_SQL,
}
