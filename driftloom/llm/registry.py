"""The registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from driftloom.llm import (
    audit,
    chunking,
    langid,
    licenses,
    lines,
    merkle,
    mixing,
    packing,
    quality,
    sharding,
    simhash,
    tokens,
    topk,
)

QUERIES = {
    "op1_edited_token_counts": tokens.op1_edited_token_counts,
    "op2_packed_sequences": packing.op2_packed_sequences,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_exact_top_k": topk.op5_exact_top_k,
    "op6_quality_scores": quality.op6_quality_scores,
    "op7_balanced_shards": sharding.op7_balanced_shards,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_simhash_components": simhash.op9_simhash_components,
    "op10_chunk_fingerprints": chunking.op10_chunk_fingerprints,
    "op11_filter_interaction": audit.op11_filter_interaction,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_language_id": langid.op13_language_id,
}
ORACLES = {
    "op3_line_dedup": lines.ORACLE,
    "op4_license_scan": licenses.ORACLE,
    "op5_exact_top_k": topk.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op11_filter_interaction": audit.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
}
