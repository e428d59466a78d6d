"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import conversation, decontaminate, exact_dedup, language, line_dedup, near_dedup, occurrence_join, packing, pii, sharding, spelling, token_files, url_filter

QUERIES = {
    "op3_sentence_hash_dedup": line_dedup.op3_sentence_hash_dedup,
    "op9_evidence_language_id": language.op9_evidence_language_id,
    "llm_page_languages": language.page_languages,
    "op10_weighted_minhash": near_dedup.op10_weighted_minhash,
    "op4_bootstrapped_pii": pii.op4_bootstrapped_pii,
    "llm_pii_held_out": pii.pii_held_out,
    "op8_string_tiling_decontamination": decontaminate.op8_string_tiling_decontamination,
    "op5_radix_exact_dedup": exact_dedup.op5_radix_exact_dedup,
    "op7_wildcard_url_filter": url_filter.op7_wildcard_url_filter,
    "op2_bit_packed_tokens": token_files.op2_bit_packed_tokens,
    "op6_best_two_fit": packing.op6_best_two_fit,
    "op1_hypergeometric_shards": sharding.op1_hypergeometric_shards,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op13_occurrence_jaccard_join": occurrence_join.op13_occurrence_jaccard_join,
    "op12_earley_conversation_repair": conversation.op12_earley_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op5_radix_exact_dedup": exact_dedup.OP5_SQL,
    "op7_wildcard_url_filter": url_filter.OP7_SQL,
    "op13_occurrence_jaccard_join": occurrence_join.OP13_SQL,
}
