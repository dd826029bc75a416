"""The registered corpus queries and their DuckDB twins where SQL has one."""

from __future__ import annotations

from moodframe.llm import decontaminate, exact_dedup, fingerprints, hard_negatives, jaccard_join, language_id, lm_score, merkle, packing, pii, quality, secrets, toxicity

QUERIES = {
    "op1_secret_scan": secrets.query,
    "op2_pii": pii.query,
    "op3_lm_scoring": lm_score.query,
    "op4_ngram_jaccard_join": jaccard_join.query,
    "op5_language_id": language_id.query,
    "op6_exact_dedup": exact_dedup.query,
    "op7_benchmark_decontamination": decontaminate.query,
    "op8_best_fit_packing": packing.query,
    "op9_quality_classifier": quality.query,
    "op10_toxicity": toxicity.query,
    "op11_merkle_manifest": merkle.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_document_fingerprints": fingerprints.query,
}

ORACLE = {
    "op4_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_exact_dedup": exact_dedup.ORACLE_SQL,
    "op7_benchmark_decontamination": decontaminate.ORACLE_SQL,
    "op11_merkle_manifest": merkle.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
}
