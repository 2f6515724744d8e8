"""Registered queries of the corpus operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from tastemill.llm import conversation_trie, decontamination, exact_dedup, hard_negatives, ngram_join, packing, pii, quality, simhash, substring_dedup, suffix_dedup, token_counts, warc

QUERIES = {
    f.__name__: f
    for f in (
        token_counts.op1_token_counts,
        exact_dedup.op2_exact_dedup,
        substring_dedup.op3_substring_dedup,
        warc.op4_warc,
        pii.op5_pii,
        ngram_join.op6_ngram_join,
        decontamination.op7_decontamination,
        quality.op8_quality,
        suffix_dedup.op9_suffix_dedup,
        packing.op10_packing,
        simhash.op11_simhash,
        conversation_trie.op12_conversation_trie,
        hard_negatives.op13_hard_negatives,
    )
}
ORACLES: dict[str, str] = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_substring_dedup": substring_dedup.ORACLE,
    "op4_warc": warc.ORACLE,
    "op6_ngram_join": ngram_join.ORACLE,
    "op7_decontamination": decontamination.ORACLE,
    "op12_conversation_trie": conversation_trie.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
}
