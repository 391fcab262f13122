"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import alignment, chat, classifier, embed, html, jaccard, linededup, mixing, packing, pii, quality, search, tokens

QUERIES = {
    "op1_quality_rules": quality.op1_quality_rules,
    "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
    "op3_pii": pii.op3_pii,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_mixing": mixing.op6_mixing,
    "op7_line_dedup": linededup.op7_line_dedup,
    "op8_html_extraction": html.op8_html_extraction,
    "op9_packing": packing.op9_packing,
    "op10_embedding_near_dedup": embed.op10_embedding_near_dedup,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_quality_classifier": classifier.op13_quality_classifier,
}
ORACLES = {
    "op1_quality_rules": quality.ORACLE,
    "op2_ngram_jaccard": jaccard.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op7_line_dedup": linededup.ORACLE,
    "op10_embedding_near_dedup": embed.ORACLE,
    "op11_lexical_search": search.ORACLE,
}
