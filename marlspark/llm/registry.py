"""The queries of this subpackage and their SQL, for __spark_entry__."""

from __future__ import annotations

from . import exact_dedup, filter_audit, html_extract, merkle, mixing, ngram_join, packing, pii, quality, sharding, token_files, toxicity, warc

QUERIES = {
    "op1_tag_path_text": html_extract.op1_tag_path_text,
    "op2_label_propagation_shards": sharding.op2_label_propagation_shards,
    "op3_kernel_toxicity": toxicity.op3_kernel_toxicity,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_warc_segments": warc.op7_warc_segments,
    "op8_packing": packing.op8_packing,
    "op9_pfair_mix": mixing.op9_pfair_mix,
    "op10_personal_data": pii.op10_personal_data,
    "op11_token_files": token_files.op11_token_files,
    "op12_filter_audit": filter_audit.op12_filter_audit,
    "op13_merkle_manifest": merkle.op13_merkle_manifest,
}

#: DuckDB SQL where SQL expresses the operator; the others are tested against brute force.
ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op7_warc_segments": warc.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
    "op13_merkle_manifest": merkle.ORACLE,
}
