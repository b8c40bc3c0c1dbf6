"""The queries of this package and their SQL."""

from __future__ import annotations

from scorelens.llm import (exact_dedup, fill_in_middle, jaccard_join, language_model, lexical_search, minhash_forest, packing,
                           personal_data, quality, sentence_pieces, token_files, toxicity, vector_search)

QUERIES = {
    "op13_minhash_forest": minhash_forest.op13_minhash_forest,
    "op11_ranked_search": lexical_search.op11_ranked_search,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op10_personal_data": personal_data.op10_personal_data,
    "op3_quality": quality.op3_quality,
    "op2_toxicity": toxicity.op2_toxicity,
    "op8_vector_search": vector_search.op8_vector_search,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op5_lm_scores": language_model.op5_lm_scores,
    "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
    "op9_token_files": token_files.op9_token_files,
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
}

ORACLE_SQL = {
    "op11_ranked_search": lexical_search.OP11_SQL,
    "op12_fill_in_middle": fill_in_middle.OP12_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
}
