"""The text operators' queries and their SQL twins, where SQL can express them."""

from __future__ import annotations

from recordlens.llm import bestfit, jaccard, language, negatives, packing, pieces, pseudo, quality, ranked, tokens, urls, vectors, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality": quality.op2_quality,
    "op3_packing": packing.op3_packing,
    "op4_url_filter": urls.op4_url_filter,
    "op5_token_counts": tokens.op5_token_counts,
    "op6_pseudo_likelihood": pseudo.op6_pseudo_likelihood,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_sampled_pieces": pieces.op8_sampled_pieces,
    "op9_language": language.op9_language,
    "op10_vector_near_copies": vectors.op10_vector_near_copies,
    "op11_best_fit": bestfit.op11_best_fit,
    "op12_ranked_search": ranked.op12_ranked_search,
    "op13_hard_negatives": negatives.op13_hard_negatives,
}

ORACLES = {
    "op1_warc": warc.OP1_SQL,
    "op2_quality": quality.OP2_SQL,
    "op7_jaccard_join": jaccard.OP7_SQL,
    "op10_vector_near_copies": vectors.OP10_SQL,
    "op12_ranked_search": ranked.OP12_SQL,
    "op13_hard_negatives": negatives.OP13_SQL,
}
