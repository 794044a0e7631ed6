"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from arborspark.llm import best_fit_packing, chat_formatting, embedding_dedup, exact_topk, html_extraction, language_id, lm_scoring, ngram_join, source_mixing, toxicity

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_registered,
    "op2_best_fit_packing": best_fit_packing.op2_query,
    "op3_exact_topk": exact_topk.op3_query,
    "op4_language_id": language_id.op4_query,
    "op5_embedding_dedup": embedding_dedup.op5_query,
    "op6_html_extraction": html_extraction.op6_query,
    "op7_toxicity": toxicity.op7_query,
    "op8_ngram_join": ngram_join.op8_query,
    "op9_chat_formatting": chat_formatting.op9_query,
    "op10_source_mixing": source_mixing.op10_query,
}
ORACLE_SQL = {"op3_exact_topk": exact_topk.OP3_SQL, "op5_embedding_dedup": embedding_dedup.OP5_SQL, "op9_chat_formatting": chat_formatting.OP9_SQL}
