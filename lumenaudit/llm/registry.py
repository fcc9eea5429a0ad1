"""Queries of the corpus operators by name, with the DuckDB SQL where SQL can express them."""

from __future__ import annotations

from lumenaudit.llm import bpe, decontaminate, importance, jaccard_join, line_dedup, pii, prefix_trie, quality_rules, sharding, spelling, suffix_dedup, toxicity, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_suffix_dedup": suffix_dedup.query,
    "op3_ftrl_toxicity": toxicity.query,
    "op4_warc_roundtrip": warc.query,
    "op5_benchmark_decontamination": decontaminate.query,
    "op6_bpe_roundtrip": bpe.query,
    "op7_ngram_jaccard": jaccard_join.query,
    "op8_pii_bootstrap": pii.query,
    "op9_vector_sharding": sharding.query,
    "op10_importance_resampling": importance.query,
    "op11_prefix_trie": prefix_trie.query,
    "op12_spelling_variants": spelling.query,
    "op13_line_dedup": line_dedup.query,
}
ORACLES: dict[str, str] = {"op4_warc_roundtrip": warc.SQL, "op5_benchmark_decontamination": decontaminate.SQL, "op11_prefix_trie": prefix_trie.SQL, "op12_spelling_variants": spelling.SQL, "op13_line_dedup": line_dedup.SQL}
