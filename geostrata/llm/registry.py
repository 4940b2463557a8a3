"""Queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from . import op1_bpe, op2_exact_dedup, op3_token_counts, op4_licenses, op5_near_dedup, op6_mixing, op7_neighbours, op8_tokens, op9_sharding, op10_language, op11_jaccard_join, op12_prefix_trie, op13_repair

QUERIES = {
    "op1_bpe": op1_bpe.query,
    "op2_exact_dedup": op2_exact_dedup.query,
    "op3_token_counts": op3_token_counts.query,
    "op4_license_scan": op4_licenses.query,
    "op5_minhash_near_dedup": op5_near_dedup.query,
    "op6_source_mix": op6_mixing.query,
    "op7_nearest_neighbours": op7_neighbours.query,
    "op8_token_shards": op8_tokens.query,
    "op9_hilbert_shards": op9_sharding.query,
    "op10_language_id": op10_language.query,
    "op11_jaccard_join": op11_jaccard_join.query,
    "op12_prefix_trie": op12_prefix_trie.query,
    "op13_structure_repair": op13_repair.query,
}

ORACLES: dict[str, str] = {
    "op2_exact_dedup": op2_exact_dedup.SQL,
    "op6_source_mix": op6_mixing.SQL,
    "op12_prefix_trie": op12_prefix_trie.SQL,
    "op13_structure_repair": op13_repair.SQL,
}
