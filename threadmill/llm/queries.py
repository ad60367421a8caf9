"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from threadmill.llm import chat_format, graph_index, media, mixing, near_dedup, packing, quality, token_files, toxicity, url_filter

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_nearest_neighbours": graph_index.op2_nearest_neighbours,
    "op3_token_files": token_files.op3_token_files,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_chat_format": chat_format.op5_chat_format,
    "op6_media_columns": media.op6_media_columns,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op9_near_duplicates": near_dedup.op9_near_duplicates,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}
ORACLES: dict[str, str] = {
    "op1_mix_sources": mixing.ORACLE,
    "op5_chat_format": chat_format.ORACLE,
    "op7_url_filters": url_filter.ORACLE,
}
