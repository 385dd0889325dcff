"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

from tillroll.llm import audit, binary, brown, centroids, decontam, iblt, jaccard, lengths, lines, mix, rlz, rules, suffix

QUERIES = {
    "op1_fuzzy_line_dedup": lines.op1_fuzzy_line_dedup,
    "op2_brown_lm_scoring": brown.op2_brown_lm_scoring,
    "op3_iblt_fingerprints": iblt.op3_iblt_fingerprints,
    "op4_rlz_substring_dedup": rlz.op4_rlz_substring_dedup,
    "op5_token_length_histogram": lengths.op5_token_length_histogram,
    "op6_ngram_jaccard_join": jaccard.op6_ngram_jaccard_join,
    "op7_benchmark_decontamination": decontam.op7_benchmark_decontamination,
    "op8_quality_classifier": rules.op8_quality_classifier,
    "op9_mix_sources": mix.op9_mix_sources,
    "op10_suffix_dedup": suffix.op10_suffix_dedup,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_centroid_clusters": centroids.op12_centroid_clusters,
    "op13_token_files": binary.op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op6_ngram_jaccard_join": jaccard.ORACLE_SQL,
    "op7_benchmark_decontamination": decontam.ORACLE_SQL,
    "op11_filter_audit": audit.ORACLE_SQL,
    "op12_centroid_clusters": centroids.ORACLE_SQL,
}
