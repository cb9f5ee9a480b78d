"""Queries of this subpackage and their reference SQL."""

from __future__ import annotations

from folimetry.llm import exact_dedup, fill_middle, lm_scores, neighbours, ngram_join, packed_ids, quality, sentence_pieces, source_mix, toxicity, url_filter, warc, whitening

QUERIES = {
    "op5_warc": warc.op5_warc,
    "op7_neighbours": neighbours.op7_neighbours,
    "op6_toxicity": toxicity.op6_toxicity,
    "op1_quality": quality.op1_quality,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op2_sentence_pieces": sentence_pieces.op2_sentence_pieces,
    "op8_packed_ids": packed_ids.op8_packed_ids,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op9_source_mix": source_mix.op9_source_mix,
    "op10_url_filters": url_filter.op10_url_filters,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_whitening": whitening.op12_whitening,
    "op13_lm_scores": lm_scores.op13_lm_scores,
}
ORACLES = {
    "op5_warc": warc.OP5_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op10_url_filters": url_filter.OP10_SQL,
    "op11_fill_middle": fill_middle.OP11_SQL,
}
