"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from lattice.llm import byte_bpe, language_model, neighbours, packing, quality_rules, simhash, suffix_dedup, token_counts, toxicity, url_filters

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_url_filters": url_filters.query,
    "op3_language_model": language_model.query,
    "op4_token_counts": token_counts.query,
    "op5_packing": packing.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_neighbours": neighbours.query,
    "op8_quality_rules": quality_rules.query,
    "op9_simhash": simhash.query,
    "op10_suffix_dedup": suffix_dedup.query,
}
ORACLE_SQL = {"op2_url_filters": url_filters.SQL, "op8_quality_rules": quality_rules.SQL, "op10_suffix_dedup": suffix_dedup.SQL}
