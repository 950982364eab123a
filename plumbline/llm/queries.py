"""The operators' registered queries, each over its whole table."""

from __future__ import annotations

from . import chat_windows, crf_quality, exact_dedup, hmm_lm, kd_search, licenses, mixing, ngram_join, sp_unigram, token_binary

QUERIES = {
    "op1_license_scan": licenses.query,
    "op2_ngram_jaccard_join": ngram_join.query,
    "op3_exact_top_k": kd_search.query,
    "op4_token_binary": token_binary.query,
    "op5_hmm_scoring": hmm_lm.query,
    "op6_chat_windows": chat_windows.query,
    "op7_quality_crf": crf_quality.query,
    "op8_mixing": mixing.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_sentencepiece": sp_unigram.query,
}
ORACLES = {
    "op1_license_scan": licenses.SQL,
    "op2_ngram_jaccard_join": ngram_join.SQL,
    "op3_exact_top_k": kd_search.SQL,
    "op8_mixing": mixing.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
