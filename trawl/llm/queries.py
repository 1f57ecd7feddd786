"""The op queries of the subpackage and their SQL."""

from __future__ import annotations

from trawl.llm import ann, bpe, exact_dedup, filter_audit, manifest, mixing, near_dedup, ngram_join, pii, quality, sharding, suffix_dedup, warc

QUERIES = {
    "op1_column_bwt": suffix_dedup.op1_column_bwt,
    "op10_raking": mixing.op10_raking,
    "op11_ngram_join": ngram_join.op11_ngram_join,
    "op12_merkle_manifest": manifest.op12_merkle_manifest,
    "op13_filter_audit": filter_audit.op13_filter_audit,
    "op2_vamana": ann.op2_vamana,
    "op3_warc": warc.op3_warc,
    "op4_pii_weak": pii.op4_pii_weak,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_dart_minhash": near_dedup.op6_dart_minhash,
    "op7_quality_ftrl": quality.op7_quality_ftrl,
    "op8_histogram_shards": sharding.op8_histogram_shards,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
}

ORACLES = {
    "op11_ngram_join": ngram_join.SQL,
    "op12_merkle_manifest": manifest.SQL,
    "op13_filter_audit": filter_audit.SQL,
    "op3_warc": warc.SQL,
    "op9_exact_dedup": exact_dedup.SQL,
}
