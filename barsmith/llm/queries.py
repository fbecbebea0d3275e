"""Queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from barsmith.llm import ann, bpe, conversations, html_text, langid, mixing, ngram_join, secrets, substrings, token_counts, topk, warc, whitening

QUERIES = {
    "op1_language_id": langid.op1,
    "op2_bpe": bpe.op2,
    "op3_repeated_substrings": substrings.op3,
    "op4_ngram_jaccard": ngram_join.op4,
    "op5_html_text": html_text.op5,
    "op6_secret_scan": secrets.op6,
    "op7_exact_top_k": topk.op7,
    "op8_mix_sources": mixing.op8,
    "op9_ann_search": ann.op9,
    "op10_warc": warc.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_token_counts": token_counts.op12,
    "op13_whitening": whitening.op13,
}

ORACLE_SQL = {
    "op3_repeated_substrings": substrings.OP3_SQL,
    "op4_ngram_jaccard": ngram_join.OP4_SQL,
    "op7_exact_top_k": topk.OP7_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_conversation_repair": conversations.OP11_SQL,
}
